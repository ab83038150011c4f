"""Column expressions: parsing, identity, names, circular and scalar math."""
