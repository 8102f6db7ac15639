"""Input schemas, loaders, catalogue storage and the bindings of the driver tables."""
