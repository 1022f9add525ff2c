"""Sources and sinks: model tables, the driver test-data adapter, CSV/JSON
files, parameterised SQL, literal relations."""
