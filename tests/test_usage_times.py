"""usage_agg and usage_carry against their SQL on odd times, by any time zone of the session and either kind of timestamp."""

import duckdb
import pytest

from siftline import catalog

#: (user, type, clock): before 1970 with parts of a millisecond, past 32-bit seconds, none, a night of summer time.
EVENTS = [(1, "view", "2024-07-01 12:00:00.5"), (1, "click", "1969-12-31 23:59:58.9995"), (1, "purchase", "1969-12-31 23:59:59.0005"), (2, "view", "2300-01-01 00:00:00"), (3, "click", None), (53, "view", "2024-03-10 02:30:00"), (3, "view", "2024-11-03 01:30:00.25"), (None, "view", "2024-01-01 00:00:00"), (4, "error", "2024-01-01 00:00:00")]


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_odd_times(spark, tmp_path, kind, zone):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE TABLE events (user_id BIGINT, event_type VARCHAR, ts {kind})")
    c.executemany("INSERT INTO events VALUES (?, ?, CAST(CAST(? AS VARCHAR) AS TIMESTAMP))", [list(e) for e in EVENTS])
    c.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'a word' AS text, 'en' AS lang, 'src' || CAST(i % 2 AS VARCHAR) AS source, 6::BIGINT AS n_chars FROM (SELECT * FROM range(1, 120) r(i) UNION ALL SELECT NULL)")
    for t in ("events", "documents"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ("usage_agg", "usage_carry"):
            df = catalog.queries()[name](spark, str(tmp_path))
            want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
            assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
