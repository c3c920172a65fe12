"""Public-suffix rules against the algorithm read out literally."""

import random

from newsloom.functions import suffix

LINES = ["// comment", "  ", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "a.b.c.jp", "*.x.com  // note", "CO.dk"]


def literal(host, lines):
    host = host.lower()
    if not host or all(c in "0123456789." for c in host):
        return None, None
    labels, found = host.split("."), []
    for line in lines:
        rule = line.split()[0].lower() if line.split() else ""
        if not rule or rule.startswith("//"):
            continue
        parts = rule.lstrip("!").split(".")
        tail = labels[-len(parts):] if len(parts) <= len(labels) else None
        if tail and all(p in ("*", t) for p, t in zip(parts, tail)):
            found.append((rule.startswith("!"), len(parts) - rule.startswith("!")))
    size = max(found)[1] if found else 1
    return ".".join(labels[-size:]), ".".join(labels[-size - 1:]) if len(labels) > size else None


def test_equals_the_algorithm(spark):
    random.seed(8)
    parts = ["www", "ck", "uk", "co", "com", "x", "jp", "kobe", "city", "a", "b", "c", "dk", "unlisted"]
    hosts = {".".join(random.choices(parts, k=random.randint(1, 5))) for _ in range(600)} | {"", "10.1.2.3", "localhost"}
    df = spark.createDataFrame([(h,) for h in hosts] + [(None,)], "link string")
    listed = suffix.rules(spark.createDataFrame([(line,) for line in LINES], "value string"))
    got = {r.link: (r.public_suffix, r.registrable) for r in suffix.with_registrable(df, "link", listed).collect()}
    assert got == {h: literal(h, LINES) for h in hosts} | {None: (None, None)}


def test_urls_and_an_empty_list(spark):
    df = spark.createDataFrame([("https://me@News.Example.co.uk:80/x?y",), ("news.example.co.uk",)], "link string")
    named = lambda lines: [r.registrable for r in suffix.with_registrable(df, "link", suffix.rules(spark.createDataFrame(lines, "value string"))).collect()]
    assert named([("co.uk",)]) == ["example.co.uk"] * 2
    assert named([]) == ["co.uk"] * 2
