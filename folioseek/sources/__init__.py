"""File sources and report sinks."""
