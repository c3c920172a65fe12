"""Near-duplicate removal against a sequential model, and its edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import fuzzy, text, url
from newsloom.functions.fuzzy import token_set_ratio
from newsloom.operators import dedup

SCHEMA = "seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string, published_at timestamp"
DAY = dt.timedelta(days=1)
BASE = dt.datetime(2024, 1, 10)


def _model(spark, df, threshold=92, days=2, wrappers=("news.google.com",)):
    """Rows kept by going through them one by one, as the definition reads."""
    keyed = df.select(
        "seq", "brand_id", "published_at",
        text.normalize_title(text.comparison_text("title", "content_teaser")).alias("text"),
        url.etld_plus_one(F.coalesce(F.nullif("link", F.lit("")), F.nullif("platform", F.lit("")), F.lit(""))).alias("domain"),
        F.regexp_replace(url.netloc("link"), r"^www\.", "").alias("host"),
    ).orderBy("seq").collect()
    kept, out = [], []
    for row in keyed:
        if not row.text:
            out.append(row.seq)
            continue
        duplicate = False
        for k in kept:
            if k.brand_id != row.brand_id or k.text.split()[:5] != row.text.split()[:5]:
                continue
            if k.domain != row.domain and not (k.host in wrappers or row.host in wrappers):
                continue
            if k.published_at and row.published_at and abs(k.published_at - row.published_at) > days * DAY:
                continue
            if token_set_ratio(row.text, k.text) >= threshold:
                duplicate = True
                break
        if not duplicate:
            kept.append(row)
            out.append(row.seq)
    return sorted(out)


def _kept(df):
    return sorted(r.seq for r in dedup.near_dedup(df, ["brand_id"]).select("seq").collect())


def _random_rows(n, seed, words, hosts, spread_days):
    random.seed(seed)
    rows = []
    for i in range(n):
        tail = " ".join(random.choices(words, k=random.randint(3, 9)))
        date = None if random.random() < 0.15 else BASE + random.randint(0, spread_days) * DAY
        title = "" if random.random() < 0.03 else f"en to tre fire fem {tail}"
        rows.append((i, random.randint(1, 2), title, "", f"https://{random.choice(hosts)}/{i}", "", date))
    return rows


def tiny(monkeypatch):
    """Tiles and lists so small that every path is taken."""
    for name, value in (("SMALL_BLOCK", 6), ("TILE_ROWS", 12), ("FIRST_LINKS", 2)):
        monkeypatch.setattr(dedup, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sequential_model_in_a_hot_block(spark, seed, monkeypatch):
    """All rows share one signature, so several rounds and both hosts and wrappers are involved."""
    tiny(monkeypatch)
    words = ["vindmølle", "havvind", "energi", "strøm", "marked", "pris", "aftale", "ny", "dansk", "norsk", "svensk", "park"]
    rows = _random_rows(220, seed, words, ["www.a.dk", "b.dk", "x.b.dk", "news.google.com"], 6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _kept(df) == _model(spark, df)


def test_without_wrappers_blocks_stay_in_their_domain(spark, monkeypatch):
    tiny(monkeypatch)
    rows = _random_rows(120, 5, ["alfa", "beta", "gamma", "delta"], ["a.dk", "b.dk"], 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _kept(df) == _model(spark, df)


def test_date_window_and_missing_dates(spark):
    row = lambda i, date: (i, 1, "Samme titel om den nye fond", "", "https://a.dk/x", "", date)
    apart = spark.createDataFrame([row(1, BASE), row(2, BASE + 3 * DAY)], SCHEMA)
    assert _kept(apart) == [1, 2]
    undated = spark.createDataFrame([row(1, BASE), row(2, None)], SCHEMA)
    assert _kept(undated) == [1]


def test_chain_keeps_both_ends(spark):
    """a resembles b and b resembles c, but a does not resemble c: c stays, since b is gone."""
    row = lambda i, date: (i, 1, "Samme titel om den nye fond", "", "https://a.dk/x", "", date)
    chain = spark.createDataFrame([row(1, BASE), row(2, BASE + 2 * DAY), row(3, BASE + 4 * DAY)], SCHEMA)
    assert _kept(chain) == [1, 3]


def test_empty_titles_always_pass(spark):
    rows = [(1, 1, "", "", "https://a.dk/1", "", None), (2, 1, None, None, "https://a.dk/2", "", None)]
    assert _kept(spark.createDataFrame(rows, SCHEMA)) == [1, 2]


def test_documents_against_model(spark):
    from newsloom.catalog.common import Roles

    raw = Roles(spark, "/root/testdata/sf0.001").raw
    assert _kept(raw) == _model(spark, raw)


def test_historical_against_brute_force(spark):
    words = ["alfa", "beta", "gamma", "delta", "epsilon", "zeta"]
    new = spark.createDataFrame(_random_rows(80, 11, words, ["a.dk", "news.google.com"], 6), SCHEMA)
    old = spark.createDataFrame(_random_rows(90, 12, words, ["a.dk", "b.dk"], 6), SCHEMA)
    got = sorted(r.seq for r in dedup.without_historical(new, old, ["brand_id"]).collect())
    both = {name: df.collect() for name, df in (("new", new), ("old", old))}
    norm = lambda t: " ".join(__import__("re").findall("[a-z0-9]+", (t or "").lower()))
    host = lambda link: link.split("/")[2].removeprefix("www.")
    keep = []
    for n in both["new"]:
        body = norm(n.title)
        hit = any(
            body and norm(o.title) and n.brand_id == o.brand_id and body.split()[:5] == norm(o.title).split()[:5]
            and (host(n.link) == host(o.link) or "news.google.com" in (host(n.link), host(o.link)))
            and (not n.published_at or not o.published_at or abs(n.published_at - o.published_at) <= 2 * DAY)
            and token_set_ratio(body, norm(o.title)) >= 92
            for o in both["old"]
        )
        if not hit:
            keep.append(n.seq)
    assert got == sorted(keep)


def test_url_dedup_fills_platform_and_drops_linkless(spark):
    rows = [
        (2, 1, "b", "", "https://www.a.dk/x/?q=1", "", None), (1, 1, "a", "", "https://a.dk/x", "", None), (3, 1, "c", "", "", "p", None),
    ]
    kept = dedup.url_dedup(spark.createDataFrame(rows, SCHEMA), ["brand_id"]).collect()
    assert [(r.seq, r.platform) for r in kept] == [(1, "a.dk")]


def test_last_in_batch(spark):
    df = spark.createDataFrame([(1, "k", 1), (2, "k", 1), (3, None, 1), (4, "", 1), (5, "k", None)], "seq bigint, post_link string, topic_id bigint")
    assert [r.seq for r in dedup.last_in_batch(df, ["post_link", "topic_id"]).collect()] == [2]


def test_a_block_of_different_titles_takes_few_rounds(spark, monkeypatch):
    """Thousands of titles with the same first five words: one pass over tiles, and rounds that do not grow with them."""
    random.seed(3)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(3, 9))) for _ in range(3000)]
    rows = []
    for i in range(4000):
        if i % 10 == 9:  # a near copy of an earlier title
            title = rows[random.randrange(len(rows))][2] + random.choice(["", "s", " x"])
        else:
            title = "en to tre fire fem " + " ".join(random.choices(words, k=8))
        rows.append((i, 1, title, "", f"https://a.dk/{i}", "", BASE + random.randint(0, 40) * DAY / 4))
    calls = []
    plain = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: calls.append(1) or plain(df))
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    kept = set(_kept(df))
    assert len(calls) <= 20
    texts, dates = {r[0]: frozenset(r[2].split()) for r in rows}, {r[0]: r[6] for r in rows}
    from newsloom.functions.fuzzy import score_tokens

    # The sequential rule; only titles that share a rare word with one another can be alike here.
    by_word, model = {}, set()
    for i in range(len(rows)):
        others = {j for w in texts[i] - {"en", "to", "tre", "fire", "fem", "x"} for j in by_word.get(w, ())}
        if not any(abs(dates[i] - dates[j]) <= 2 * DAY and score_tokens(texts[i], texts[j]) >= 92 for j in others):
            model.add(i)
            for w in texts[i]:
                by_word.setdefault(w, []).append(i)
    assert kept == model and len(model) < len(rows)


@pytest.mark.parametrize("threshold", [75, 92])
def test_tiles_never_skip_a_pair_that_reaches_the_threshold(threshold):
    from newsloom.functions.fuzzy import Peer, Tile, first_kept, is_duplicate, links, resembling

    random.seed(4)
    words = ["vind", "vinde", "havvind", "park", "parker", "energi", "energien", "pris", "priser", "x1", "y2"]
    words += [f"unikt{i}ord" for i in range(40)]

    def tile(n, start):
        dates = [random.choice([None, 0, 5, 10]) for _ in range(n)]
        peers = [Peer.of(" ".join(random.choices(words, k=random.randint(4, 7))), d, random.choice("ab"), random.random() < 0.2) for d in dates]
        return Tile(peers, random.sample(range(start, start + 3 * n), n))

    a, b = tile(60, 0), tile(200, 100)
    alike = lambda p, q: is_duplicate(p, q, threshold, 5)
    assert resembling(b, a, threshold, 5) == {i for i, p in zip(b.seqs.tolist(), b.peers) if any(alike(p, q) for q in a.peers)} != set()
    for most in (1, 3):
        inside = sorted((i, j) for j, q in zip(a.seqs.tolist(), a.peers) for i, p in zip(a.seqs.tolist(), a.peers) if j < i and alike(p, q))
        want = sorted(x for i in set(a.seqs.tolist()) for x in [y for y in inside if y[0] == i][:most])
        assert sorted(links(a, a, threshold, 5, most)) == want
        both = sorted((max(i, j), min(i, j)) for i, p in zip(a.seqs.tolist(), a.peers) for j, q in zip(b.seqs.tolist(), b.peers) if i != j and alike(p, q))
        want = sorted(x for i in {y[0] for y in both} for x in [y for y in both if y[0] == i][:most])
        assert sorted(links(a, b, threshold, 5, most)) == want
    kept = []
    for i, p in sorted(zip(b.seqs.tolist(), b.peers)):
        if not any(alike(p, q) for q in [*a.peers, *(k for _, k in kept)]):
            kept.append((i, p))
    assert b.seqs[first_kept(b, threshold, 5, a.peers)].tolist() == [i for i, _ in kept]


def _near_copies(n, seed):
    """Rows of one block: nearly all are copies of one text with a word changed, some are others'."""
    random.seed(seed)
    words = [f"ord{random.randint(100, 999)}" for _ in range(40)]
    rows = []
    for i in range(n):
        changed = [f"nyt{i}" if k == i % 30 + 6 else w for k, w in enumerate(words)]
        changed[5:] = changed[5:] if i % 11 else random.sample(changed[5:], 9)
        rows.append((i, 1, " ".join(changed), "", f"https://a.dk/{i}", "", BASE + (i % 5) * DAY))
    return rows


def test_copies_are_told_from_few_pairs(monkeypatch):
    """The pairs looked at grow with rows times rows that stay, not with rows squared."""
    rows, seen, plain = _near_copies(800, 3), [0], fuzzy._possible

    def counted(a, b, *more):
        seen[0] += len(a) * len(b)
        return plain(a, b, *more)

    monkeypatch.setattr(fuzzy, "_possible", counted)
    copies = [r for r in rows if r[0] % 11]
    tile = fuzzy.Tile([fuzzy.Peer.of(r[2], 0, "a.dk", False) for r in copies], [r[0] for r in copies])
    assert fuzzy.first_kept(tile, 92, 0) == [0]
    assert seen[0] < 4 * len(copies)


def test_a_block_of_copies_needs_no_graph(spark, monkeypatch):
    """Blocks of copies end in passes over their rows; only what resembles no first row is left to the rounds."""
    tiny(monkeypatch)
    left, plain = [], dedup._graph_losers
    monkeypatch.setattr(dedup, "_graph_losers", lambda rows, *more: left.append(rows.count()) or plain(rows, *more))
    rows = _near_copies(120, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _kept(df) == _model(spark, df)
    assert sum(left) < len(rows) / 4


def test_historical_copies_meet_few_stored_rows(spark, monkeypatch):
    tiny(monkeypatch)
    met, plain = [], dedup._tile_pairs
    monkeypatch.setattr(dedup, "_tile_pairs", lambda new, *more: met.append(new.select(F.sum(F.size("rows"))).first()[0] or 0) or plain(new, *more))
    rows = _near_copies(140, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    old, new = df.filter("seq < 70"), df.filter("seq >= 70")
    got = {r.seq for r in dedup.without_historical(new, old, ["brand_id"]).select("seq").collect()}
    text_of = {r[0]: (text_, r[6]) for r in rows for text_ in [r[2]]}
    hit = lambda a, b: abs(text_of[a][1] - text_of[b][1]) <= 2 * DAY and token_set_ratio(text_of[a][0], text_of[b][0]) >= 92
    assert got == {s for s in range(70, 140) if not any(hit(s, o) for o in range(70))}
    assert sum(met) < 35
