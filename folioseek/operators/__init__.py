"""DataFrame operators: chunking, indexing, retrieval, library, cases, reports."""
