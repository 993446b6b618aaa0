"""Operators for preparing large training corpora. Nothing else in sparkloom imports this subpackage."""
