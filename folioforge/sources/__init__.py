"""Sources and sinks: files into rows of elements, tables out."""
