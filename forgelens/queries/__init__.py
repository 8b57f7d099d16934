"""One named query per operator over the check tables, with the SQL that must give the same rows."""
