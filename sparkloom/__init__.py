"""sparkloom: retrieval, metering and corpus analytics expressed as Spark plans."""
