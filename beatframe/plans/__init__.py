from beatframe.plans import check_queries, frame_queries, linear_queries, mesh_queries, metric_queries, source_queries  # noqa: F401  they register their queries
