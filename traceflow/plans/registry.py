"""Where queries register: name -> query(spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The SQL form of the views of traceflow.sources.views.
VIEWS_SQL = {
    "cube": "cube AS (SELECT vec_id, vec_id // 25 AS inl, vec_id % 25 AS crl, z, CAST(embedding[z + 1] AS DOUBLE) AS amp FROM embeddings, (SELECT unnest(range(64)) AS z))",
    "cube_ig": "cube_ig AS (SELECT vec_id, vec_id // 25 AS inl, vec_id % 25 AS crl, z, CAST(embedding[z + 1] AS DOUBLE) AS a, CAST(embedding[z + 33] AS DOUBLE) AS b FROM embeddings, (SELECT unnest(range(32)) AS z))",
    "stacks": "stacks AS (SELECT vec_id, z, CAST(embedding[z + 1] AS DOUBLE) AS s1, CAST(embedding[z + 17] AS DOUBLE) AS s2, CAST(embedding[z + 33] AS DOUBLE) AS s3, CAST(embedding[z + 49] AS DOUBLE) AS s4 FROM embeddings, (SELECT unnest(range(16)) AS z))",
    "stacks5": "stacks5 AS (SELECT vec_id, z, CAST(embedding[z + 1] AS DOUBLE) AS s1, CAST(embedding[z + 14] AS DOUBLE) AS s2, CAST(embedding[z + 27] AS DOUBLE) AS s3, CAST(embedding[z + 40] AS DOUBLE) AS s4, CAST(embedding[z + 52] AS DOUBLE) AS s5 FROM embeddings, (SELECT unnest(range(13)) AS z))",
    "stations": "stations AS (SELECT user_id AS line, trcnr, CASE WHEN user_id % 2 = 0 THEN trcnr + 0.25 ELSE (user_id // 2) % 40 + 0.5 - 0.03 * trcnr END::DOUBLE AS x, CASE WHEN user_id % 2 = 0 THEN (user_id // 2) % 40 + 0.5 + 0.05 * trcnr ELSE trcnr + 0.25 END::DOUBLE AS y, z FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trcnr, CAST(value AS DOUBLE) AS z FROM events))",
    "arr": "arr AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)",
    "horizon2d": "horizon2d AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trcnr, CAST(value AS DOUBLE) AS z FROM events)",
    "misties": "misties AS (SELECT a.l_orderkey AS okey, a.l_suppkey AS line_a, CAST(a.l_linenumber AS BIGINT) AS trc_a, b.l_suppkey AS line_b, CAST(b.l_linenumber AS BIGINT) AS trc_b, CAST(a.l_quantity AS DOUBLE) - CAST(b.l_quantity AS DOUBLE) AS zdiff, 1000 * (CAST(a.l_tax AS DOUBLE) - CAST(b.l_tax AS DOUBLE)) AS phasediff, CAST(a.l_extendedprice AS DOUBLE) / CAST(b.l_extendedprice AS DOUBLE) AS ampdiff, 1 - 5 * abs(CAST(a.l_discount AS DOUBLE) - CAST(b.l_discount AS DOUBLE)) AS quality FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)",
    "points": "points AS (SELECT c_custkey AS id, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) AS v FROM customer)",
    "faults": "faults AS (SELECT fault, seq, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM (VALUES (1, 1, 10.5, -5.0, 30.2, 40.3), (1, 2, 30.2, 40.3, 20.7, 95.1), (2, 1, 60.3, 10.4, 80.6, 70.2)) f(fault, seq, x1, y1, x2, y2))",
}


def sql(views: str, body: str) -> str:
    """body after the views it names (separated by blanks)."""
    return "WITH RECURSIVE " + ",\n".join(VIEWS_SQL[v] for v in views.split()) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body


def query(name: str, oracle: str | None = None):
    """Register the decorated query(spark, sf_dir)."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep
