"""Sources and sinks: key/value store, typed collections, archives."""
