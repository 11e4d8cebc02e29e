import random

import pytest

from feedrank.operators import dedup as d
from feedrank.operators.dedup import dedup, survivors

COLUMNS = "run_date string, ord bigint, canonical_url string, title_norm string, content_hash string"


def _fold(rows):
    """The definition, one row after the other."""
    kept, seen = [], {}
    for run_date, ord_, url, title, digest in sorted(rows, key=lambda r: (r[0], r[1])):
        host = url.split("/")[2] if url and url.startswith("http://") else ""
        keys = {("u", url)} if url else set()
        if title and host:
            keys.add(("t", host, title))
        if digest:
            keys.add(("h", digest))
        if keys & seen.setdefault(run_date, set()):
            continue
        seen[run_date] |= keys
        kept.append((run_date, ord_))
    return sorted(kept)


def _random_rows(n, dates, urls, titles, hashes, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = rng.choice(["", "plain", *(f"http://h{u % 3}/{u}" for u in range(urls))])
        title = rng.choice(["", *(f"t{t}" for t in range(titles))])
        digest = rng.choice(["", *(f"c{c}" for c in range(hashes))])
        rows.append((f"d{rng.randrange(dates)}", i - 5, url, title, digest))
    return rows


def _kept(spark, rows, **options):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return sorted((r.run_date, r.ord) for r in survivors(df, **options).collect())


def test_a_dropped_item_does_not_block(spark):
    rows = [
        ("d", 0, "http://x/1", "t1", "a"),
        ("d", 1, "http://x/1", "t2", "b"),
        ("d", 2, "http://x/2", "t2", "c"),
    ]
    assert _kept(spark, rows) == [("d", 0), ("d", 2)]


def test_titles_match_on_the_same_host_only(spark):
    rows = [
        ("d", 0, "http://x/1", "t", "a"),
        ("d", 1, "http://y/1", "t", "b"),
        ("d", 2, "http://y/2", "t", "c"),
        ("e", 3, "http://x/1", "t", "a"),
    ]
    assert _kept(spark, rows) == [("d", 0), ("d", 1), ("e", 3)]


def test_items_without_host_match_by_hash(spark):
    rows = [("d", 0, "foo", "t", "same"), ("d", 1, "bar", "t", "same"), ("d", 2, "", "", "")]
    assert _kept(spark, rows) == [("d", 0), ("d", 2)]


@pytest.mark.parametrize("slow", [d.SLOW_ROUND, 1.0, 0.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_items_match_the_definition(spark, monkeypatch, slow, seed):
    """With rounds and order, with order after one round, and with rounds alone."""
    monkeypatch.setattr(d, "SLOW_ROUND", slow)
    rows = _random_rows(150, 2, 25, 20, 60, seed)
    assert _kept(spark, rows) == _fold(rows)


def test_without_scope(spark):
    rows = [("d", *r[1:]) for r in _random_rows(120, 1, 20, 15, 50, 7)]
    df = spark.createDataFrame(rows, COLUMNS)
    expected = [ord_ for _, ord_ in _fold(rows)]
    assert sorted(r.ord for r in survivors(df, scope=()).collect()) == expected


def _braid(n):
    """Each item meets two before it."""
    return [("d", i, f"http://h/{i // 3}", f"t{(i + 1) // 3}", f"c{(i + 2) // 3}") for i in range(n)]


def _chain(n):
    """Each item shares its URL with the one before and its title with the one after."""
    return [("d", i, f"http://h/{(i + 1) // 2}", f"t{i // 2}", f"c{i}") for i in range(n)]


def _interleaved(n, rows):
    """Many chains side by side, so that every boundary is wide."""
    return [("d", i, f"http://h/{i % rows}/{(i // rows + 1) // 2}", f"t{i % rows}/{i // rows // 2}", f"c{i}") for i in range(n)]


@pytest.mark.parametrize("make", [_chain, _braid])
def test_rows_of_items_through_all_blocks_need_few_steps(spark, monkeypatch, make):
    steps, original = [], d._kept_in_blocks
    monkeypatch.setattr(d, "BLOCK_ITEMS", 25)
    monkeypatch.setattr(d, "_kept_in_blocks", lambda *a: steps.append(a[-1]) or original(*a))
    monkeypatch.setattr(d, "_kept_in_chains", lambda *a: pytest.fail("not needed"))
    rows = make(1000)  # 40 blocks
    assert _kept(spark, rows) == _fold(rows)
    assert steps == [False, True]


def test_a_task_settles_no_more_than_a_block(spark, monkeypatch):
    sizes, original = [], d._blocks
    monkeypatch.setattr(d, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(
        d, "_blocks", lambda *a: (found := original(*a), sizes.extend(r["count"] for r in found.groupBy("block").count().collect()))[0])
    for rows in (_braid(300), _random_rows(400, 1, 30, 30, 200, 3)):
        assert _kept(spark, rows) == _fold(rows)
    assert sizes and max(sizes) <= 80


def test_wide_boundaries_are_left_to_chains(spark, monkeypatch):
    used, original = [], d._kept_in_chains
    monkeypatch.setattr(d, "BLOCK_ITEMS", 30)
    monkeypatch.setattr(d, "_kept_in_chains", lambda *a: used.append(1) or original(*a))
    rows = _interleaved(450, 10)
    assert _kept(spark, rows) == _fold(rows)
    assert used == [1]


@pytest.mark.parametrize("block", [7, 30])
@pytest.mark.parametrize("seed", [3, 4])
def test_any_blocks_match_the_definition(spark, monkeypatch, block, seed):
    monkeypatch.setattr(d, "BLOCK_ITEMS", block)
    monkeypatch.setattr(d, "SLOW_ROUND", 1.0)  # every way is taken in turn
    rows = _random_rows(110, 2, 25, 20, 60, seed)
    assert _kept(spark, rows) == _fold(rows)


def test_boundaries_are_put_one_after_the_other():
    chain = [(0, [], [b"a"], [1]), (1, [b"a"], [b"b"], [1, 0]), (2, [b"b"], [b"c"], [1, 0]), (3, None, None, None), (4, [b"c"], [], [0, 0])]
    met, last = d._met(chain)
    assert last == 3 and met[1] == {b"a"} and met[2] == set() and b"c" in met[3] and 4 not in met


def test_hot_key_is_whole_and_split(spark):
    """A third of all items share one URL; the others are unique."""
    rows = [
        ("d", i, "http://h/hot" if i % 3 == 0 else f"http://h/{i}", f"t{i}", f"c{i}") for i in range(300)
    ]
    rows[0] = ("d", 0, "http://h/other", "t3", "c0")  # blocks the first item of the hot key
    assert _kept(spark, rows) == _fold(rows)


def test_one_title_on_every_item(spark):
    rows = [("d", i, f"http://h/{i}", "same", f"c{i}") for i in range(200)]
    assert _kept(spark, rows) == [("d", 0)]


def test_order_of_the_input_rows_does_not_matter_and_dedup_is_idempotent(spark):
    rows = _random_rows(100, 2, 20, 15, 40, 11)
    df = spark.createDataFrame(rows, COLUMNS)
    once = dedup(df.repartition(5))
    twice = dedup(once)
    expected = _fold(rows)
    for result in (once, twice):
        assert sorted((r.run_date, r.ord) for r in result.collect()) == expected


def test_one_date_equals_its_slice_of_the_archive(spark):
    rows = _random_rows(120, 3, 20, 15, 40, 13)
    archive = _kept(spark, rows)
    for date in ("d0", "d1", "d2"):
        alone = _kept(spark, [r for r in rows if r[0] == date])
        assert alone == [k for k in archive if k[0] == date]


def test_no_items(spark):
    assert _kept(spark, []) == []


def test_wrong_positions_are_refused(spark):
    rows = [("d", 1, "http://h/1", "t", "a"), ("d", 1, "http://h/2", "u", "b")]
    with pytest.raises(ValueError, match="more than one item"):
        _kept(spark, rows)
    for bad in ((None, 1), ("d", None), ("d", 1 << 61)):
        with pytest.raises(Exception, match="must not be null"):
            _kept(spark, [(*bad, "http://h/1", "t", "a")])


def test_the_way_does_not_hang_on_the_size(spark, monkeypatch):
    """Few items and many go through the same steps."""
    seen = []
    for name in ("_first_on_all_keys", "_unblocked", "_kept_in_blocks"):
        own = getattr(d, name)
        monkeypatch.setattr(d, name, lambda *a, own=own, name=name: seen.append(name) or own(*a))
    steps = []
    for n in (100, 1_000_000):
        ids = spark.range(n).selectExpr(
            "'d' AS run_date", "id AS ord", "concat('http://h/', id % (bigint(%d) div 2))" .replace("%d", str(n)) + " AS canonical_url",
            "concat('t', id) AS title_norm", "concat('c', id) AS content_hash")
        seen.clear()
        assert survivors(ids).count() == n // 2
        steps.append(list(seen))
    assert steps[0] == steps[1] == ["_first_on_all_keys", "_unblocked"]
