"""Content-addressed storage of artifacts: chunking, exact and near-duplicate elimination, collection."""
