"""The registered queries by subject: each applies an operator to the tables of a folder."""
