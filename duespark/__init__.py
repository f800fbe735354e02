"""duespark: accounts-payable analytics as composable PySpark DataFrame functions."""
