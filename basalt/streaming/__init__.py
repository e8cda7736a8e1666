"""Request streams: statements that arrive one after another over a terminal or a socket."""
