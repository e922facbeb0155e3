import io
import threading
import time
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ontology
from graphloom.operators.jobs import BoundedPool, JobError, KeyedJobs, once
from graphloom.operators.profile import load
from graphloom.sources import rdf
from graphloom.sources.store import ParquetStore, QuadStore, StoreError


def test_bounded_pool():
    pool, seen = BoundedPool(2), []

    def work(x):
        seen.append(x)
        if x == 2:
            raise ValueError("two")
        return x * x

    assert pool.invoke(lambda x: x + 1, [1, 2, 3]) == [2, 3, 4]
    with pytest.raises(JobError, match="1 of 4") as e:
        pool.invoke(work, range(4))
    assert sorted(seen) == [0, 1, 2, 3] and [(x, str(f)) for x, f in e.value.failures] == [(2, "two")]
    gate = threading.Event()
    other = threading.Thread(target=lambda: pool.invoke(lambda _: gate.wait(5), [1]))
    other.start()
    time.sleep(0.1)
    with pytest.raises(JobError, match="at work"):
        pool.invoke(work, [])
    gate.set()
    other.join()
    assert pool.invoke(work, [5]) == [25]


def test_keyed_jobs(spark):
    jobs = KeyedJobs(spark)
    assert jobs.submit("n", lambda: spark.range(5).count()).result() == 5
    gate = threading.Event()
    jobs.submit("slow", gate.wait, 20)
    with pytest.raises(JobError, match="slow is at work"):
        jobs.submit("slow", gate.wait, 1)
    assert jobs.busy() == ["slow"]
    jobs.wait_until(most=1, seconds=1)
    gate.set()
    jobs.wait_until()
    jobs.submit("slow", lambda: spark.range(10**12).agg(F.bit_xor(F.xxhash64("id"))).collect())
    with pytest.raises(JobError, match="cancelled"):
        jobs.wait_until(seconds=2)
    jobs.wait_until(seconds=60)
    assert jobs.jobs["slow"].exception() is not None
    jobs.close()


def test_once():
    made = []

    @once
    def value():
        made.append(1)
        if len(made) == 1:
            raise ValueError
        time.sleep(0.05)
        return 7

    with pytest.raises(ValueError):
        value()
    got = []
    threads = [threading.Thread(target=lambda: got.append(value())) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [7] * 8 and len(made) == 2


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_transactions(spark, tmp_path, kind):
    g = rdf.from_turtle(spark, "<u:1> <u:p> <u:2> .")
    more = rdf.from_turtle(spark, "<u:3> <u:p> <u:4> .")
    store = QuadStore(spark, g) if kind == "memory" else ParquetStore(spark, str(tmp_path / "s"), g)
    with store.transaction() as t:
        store.add_data(more)  # by another writer: the reader's state stays
        assert t.quads.count() == 1
        with store.transaction() as same:
            assert same is t
        with pytest.raises(StoreError, match="inside a read"), store.transaction(write=True):
            pass
        with pytest.raises(StoreError, match="inside a read"):
            t.add_data(more)
    assert store.quads.count() == 2
    with pytest.raises(ZeroDivisionError), store.transaction(write=True) as t:
        t.remove_data(g)
        assert t.quads.count() == 1
        raise ZeroDivisionError
    assert store.quads.count() == 2
    with store.transaction(write=True) as t:
        t.remove_data(g)
        with store.transaction(write=True) as same:
            same.remove_data(more)
    assert store.quads.count() == 0


def test_workbook(spark, tmp_path):
    p = load('{types: {T: {rules: {rdfType: "u:T"}, attributes: {a: {uri: "u:a", rules: {range: {datatype: "xsd:string"}, minCardinality: 1}}}}}}')
    path = tmp_path / "p.xlsx"
    ontology.write_xlsx(spark, p, str(path))
    with zipfile.ZipFile(io.BytesIO(path.read_bytes())) as z:
        assert z.testzip() is None and all(ET.fromstring(z.read(n)) is not None for n in z.namelist())
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rows = [{c.get("r"): "".join(c.itertext()) for c in row} for row in sheet.iter(m + "row")]
    assert len(rows) == 3 and list(rows[0].values())[:3] == ["type", "attribute", "uri"] and rows[2]["E3"] == "1..n" and rows[1]["F2"] == "1" and "B2" not in rows[1]
    assert b'r="AB1"' in zipfile.ZipFile(io.BytesIO(ontology.workbook([list(range(28))]))).read("xl/worksheets/sheet1.xml")
