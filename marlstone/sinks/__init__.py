"""Writers and rendered outputs."""
