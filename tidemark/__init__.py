"""Trial, event-log and multichannel-signal analytics as Spark DataFrame operators."""
