"""All queries of the core, by name."""

from kinweave.plans import battery_queries, core_queries, feature_queries, graph_queries, io_queries, relational_queries

FLAGSHIP = "p3_found"
QUERIES = {**core_queries.QUERIES, **relational_queries.QUERIES, **graph_queries.QUERIES, **feature_queries.QUERIES, **battery_queries.QUERIES, **io_queries.QUERIES}
SQL = {**core_queries.SQL, **relational_queries.SQL, **graph_queries.SQL, **feature_queries.SQL, **battery_queries.SQL, **io_queries.SQL}
