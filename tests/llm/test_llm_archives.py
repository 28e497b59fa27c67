"""Fixity audit and dated URL lists against direct computations."""

import random
from datetime import datetime, timedelta

from docquarry.llm.fixity import audit, leaves
from docquarry.llm.url_lists import filter_captures, host_suffixes, validity_intervals
from pyspark.sql import functions as F

CHUNKS = "namespace string, chunk_id string, chunk_index bigint, text string, hash string, records int"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CHUNKS).repartition(3)


def test_audit_names_exactly_the_differing_offsets(spark):
    rng = random.Random(1)
    rows = [(f"a{i % 3}", f"id{i}", i, f"text {i}") for i in range(700)] + [("a0", "big", 5_000_000, "é" * 200_000)]
    rows += [(None, "x", 1, None), ("a1", None, None, ""), ("a1", "same", 9, "t"), ("a1", "same", 9, "t")]
    other = []
    for r in rows:
        if r[1] == "id30":
            continue
        other.append((r[0], r[1], r[2], "changed") if r[1] in ("id7", "big") else r)
    other += [("a2", "new", 801, "z"), ("a1", "same", 9, "t"), (None, "x", 2, None)]
    rng.shuffle(other)
    got = {(r.namespace, r.chunk_index): (r.status, r.expected_records, r.found_records) for r in audit(chunks(spark, rows), chunks(spark, other), fanout=4).collect()}
    assert got == {
        ("a0", 30): ("missing", 1, 0), ("a1", 7): ("changed", 1, 1), ("a0", 5_000_000): ("changed", 1, 1),
        ("a2", 801): ("extra", 0, 1), ("a1", 9): ("changed", 2, 3), ("", 2): ("extra", 0, 1)}
    assert audit(chunks(spark, rows), chunks(spark, rows[::-1])).count() == 0


def test_audit_of_empty_replicas_and_null_contents(spark):
    rows = [("a", "x", 0, None)]
    assert audit(chunks(spark, []), chunks(spark, [])).count() == 0
    assert [r.status for r in audit(chunks(spark, rows), chunks(spark, [])).collect()] == ["missing"]
    assert [r.status for r in audit(chunks(spark, rows), chunks(spark, [("a", "x", 0, "")])).collect()] == ["changed"]
    assert leaves(chunks(spark, [("a", "xy", 0, "z")])).first().hash != leaves(chunks(spark, [("a", "x", 0, "yz")])).first().hash


def test_captures_meet_the_entries_of_their_time(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    time = lambda: start + timedelta(hours=rng.randint(0, 40))
    domains = ["example.com", "a.example.com", "b.a.example.com", "example.org", "com"]
    entries = [(rng.choice(["spam", "adult"]), rng.choice(domains), rng.choice(["add", "remove"]), time(), "x") for _ in range(60)]
    entries += [(None, "example.com", "add", start, "x"), ("spam", "", "add", start, "x"), ("spam", "example.com", "keep", start, "x"), ("spam", "example.com", "add", None, "x")]
    urls = ["http://a.example.com/x", "https://user@B.a.Example.com.:8080/?q", "http://example.org", "notaurl", None, "http://xexample.com/", "http:///path"]
    captures = [(i, rng.choice(urls), rng.choice([time(), time(), None]), "x", "x") for i in range(80)] * 2
    docs = spark.createDataFrame(captures, "doc_id bigint, source string, fetched_at timestamp, host string, lists string")
    listed = spark.createDataFrame(entries, "list_name string, domain string, action string, listed_at timestamp, valid_to string")
    hosts = {urls[0]: "a.example.com", urls[1]: "b.a.example.com", urls[2]: "example.org", urls[5]: "xexample.com"}
    want = []
    for i, url, at, _, _ in captures:
        host, held = hosts.get(url), set()
        for name in ("spam", "adult"):
            for d in domains:
                events = sorted((t, a) for n, e, a, t, _ in entries if n == name and e == d and t and a in ("add", "remove") and at and t <= at)
                if events and host and (host == d or host.endswith("." + d)) and events[-1][1] == "add":
                    held.add(name)
        want.append((i, url, host, sorted(held), bool(held)))
    for limit in (100_000, 0):
        got = [tuple(r) for r in filter_captures(docs, listed, broadcast_entries=limit).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert filter_captures(docs.limit(0), listed).count() == 0
    assert not any(r.blocked for r in filter_captures(docs, listed.limit(0)).collect())


def test_intervals_and_suffixes(spark):
    rows = [("l", "D ", "add", datetime(2024, 1, 1)), ("l", "d", "remove", datetime(2024, 1, 1)), ("l", "d", "ADD", datetime(2024, 1, 2)), ("l", "d", "add", datetime(2024, 1, 3))]
    got = validity_intervals(spark.createDataFrame(rows, "list_name string, domain string, action string, listed_at timestamp")).orderBy("valid_from").collect()
    assert [(r.valid_from.day, r.valid_to and r.valid_to.day) for r in got] == [(2, 3), (3, None)]
    assert spark.range(1).select(host_suffixes(F.lit("a.b.c"))).first()[0] == ["a.b.c", "b.c", "c"]


def test_hosts_of_addresses(spark):
    from docquarry.llm.url_lists import host_of

    urls = [("http://[2001:DB8::1]:80/x", "[2001:db8::1]"), ("http://[2001:aaaa::2]/y", "[2001:aaaa::2]"), ("https://u:p@Example.ORG.:8443/a:b", "example.org"), ("http://u@[::1]", "[::1]"), ("http:///x", None), ("http://[", None), (None, None)]
    rows = spark.createDataFrame(urls, "url string, host string").select(host_of(F.col("url")), "host").collect()
    assert [r[0] for r in rows] == [h for _, h in urls]
