"""Streaming price ingest: files in a folder -> stored table, rejects apart, no double load."""
import os
import tempfile
import uuid

from basketry.streaming.ingest import ingest_prices


def test_ingest_twice_loads_once(spark):
    base = tempfile.mkdtemp(prefix="basketry-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "p1.csv"), "w") as f:
        f.write("dt;open;high;low;close;adj_close;volume;symbol;index_name;currency\n")
        f.write("2020-01-02;1;1;1;1;1.5;10;A;I;EUR\n2021-01-02;1;1;1;1;2.5;10;A;I;EUR\n2020-01-03;1;1;1;1;x;10;B;I;EUR\n2020-01-04;1;1;1;1;;10;C;I;EUR\n")
    table, rej = os.path.join(base, "table"), os.path.join(base, "rej")
    name = "t" + uuid.uuid4().hex[:8]
    ingest_prices(spark, src, table, rej, name).awaitTermination(120)
    ingest_prices(spark, src, table, rej, name).awaitTermination(120)   # restart: nothing new
    got = spark.read.parquet(table)
    assert got.count() == 2
    assert sorted(r.year for r in got.select("year").collect()) == [2020, 2021]
    lines = sorted(r.line for r in spark.read.parquet(rej).collect())
    assert len(lines) == 2 and "x;10;B" in lines[0] and ";C;I;EUR" in lines[1]   # a missing price keeps its text
