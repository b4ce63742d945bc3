"""Writers and build-once stages."""
