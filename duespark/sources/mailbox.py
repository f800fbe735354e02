"""SRC-08: a folder of mail as a table and as a stream of attachments.

    spark.dataSource.register(MailboxSource)
    spark.read.format("mailbox").option("after_uid", 120).load(folder)
    spark.readStream.format("mailbox").option("sender", "@acme").load(folder)

The folder holds one message a file, <uid>.eml, and lies where driver and executors read it (a path or a URI of any
file system that Arrow knows). A stream's offset is the largest UID that was taken in, kept in the checkpoint: a
message is taken in once, also over restarts, provided that UIDs only grow, as a mailbox's do. Only the names of the
files pass through the driver; each partition reads its own messages.

Options: after_uid (0): messages up to that UID are left out; sender: part of the From line, case aside;
types: MIME types of attachments, by comma (PDF, JPEG and PNG); messages_per_partition (200).

Defined results: a message without such attachments gives no row; files of other names are left out; a message that
isn't well formed is read as far as it can be; one without a date has a null date, an attachment without a name is
called after its message, as "attachment-<uid>".
"""

from __future__ import annotations

import re
from datetime import UTC
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: MIME types of invoices, and other names of theirs.
TYPES = ("application/pdf", "image/jpeg", "image/png")
ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-png": "image/png"}
SCHEMA = "uid bigint, message_id string, sender string, subject string, received_at timestamp, attachment int, name string, mime string, content binary"


class Messages(InputPartition):
    """UIDs of one task's messages."""

    def __init__(self, uids: list[int]):
        self.uids = uids


class Mailbox:
    """A folder of messages and the options of a read."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.after = int(options.get("after_uid", "0"))
        self.sender = options.get("sender", "").lower()
        self.types = tuple(t.strip().lower() for t in options.get("types", ",".join(TYPES)).split(","))
        self.each = max(1, int(options.get("messages_per_partition", "200")))

    def folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def uids(self, after: int, upto: int | None = None) -> list[int]:
        from pyarrow import fs

        system, path = self.folder()
        names = (re.fullmatch(r"(\d+)\.eml", f.base_name) for f in system.get_file_info(fs.FileSelector(path)))
        return sorted(u for n in names if n and (u := int(n[1])) > after and (upto is None or u <= upto))

    def partitions(self, uids: list[int]) -> list[Messages]:
        return [Messages(uids[k : k + self.each]) for k in range(0, len(uids), self.each)] or [Messages([])]

    def rows(self, partition: Messages):
        system, path = self.folder()
        for uid in partition.uids:
            with system.open_input_stream(f"{path}/{uid}.eml") as f:
                message = message_from_bytes(f.read(), policy=policy.default)
            sender = str(message.get("From", ""))
            if self.sender not in sender.lower():
                continue
            try:
                at = parsedate_to_datetime(str(message["Date"]))
                at = at.replace(tzinfo=UTC) if at.tzinfo is None else at
            except (TypeError, ValueError):
                at = None
            parts = [p for p in message.walk() if not p.is_multipart() and (p.get_content_disposition() == "attachment" or p.get_filename())]
            for k, part in enumerate(parts):
                mime = part.get_content_type().lower()
                mime = ALIASES.get(mime, mime)
                if mime in self.types:
                    yield uid, str(message.get("Message-ID", "")).strip(), sender, str(message.get("Subject", "")), at, k, part.get_filename() or f"attachment-{uid}", mime, part.get_payload(decode=True) or b""


class MailboxReader(DataSourceReader):
    def __init__(self, mailbox: Mailbox):
        self.mailbox = mailbox

    def partitions(self):
        return self.mailbox.partitions(self.mailbox.uids(self.mailbox.after))

    def read(self, partition):
        yield from self.mailbox.rows(partition)


class MailboxStream(DataSourceStreamReader):
    def __init__(self, mailbox: Mailbox):
        self.mailbox = mailbox

    def initialOffset(self) -> dict:  # noqa: N802
        return {"uid": self.mailbox.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"uid": max(self.mailbox.uids(self.mailbox.after), default=self.mailbox.after)}

    def partitions(self, start: dict, end: dict):
        return self.mailbox.partitions(self.mailbox.uids(start["uid"], end["uid"]))

    def read(self, partition):
        yield from self.mailbox.rows(partition)


class MailboxSource(DataSource):
    """The attachments of a folder of messages."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return MailboxReader(Mailbox(self.options))

    def streamReader(self, schema):  # noqa: N802
        return MailboxStream(Mailbox(self.options))
