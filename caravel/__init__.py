"""Analytics over travel and media archives as Spark plans."""
