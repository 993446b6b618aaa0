"""Part of sparkloom; see the README for an overview."""
