"""Sources and sinks: the driver-table binding and file readers/writers."""
