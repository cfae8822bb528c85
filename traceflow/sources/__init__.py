"""Sources and sinks, and the views of the driver tables as traces, lines, ties and points."""
