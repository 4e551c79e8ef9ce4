"""The crawl with quotas: owners, caps, resumption after a broken level, against a loop over sets."""

import random

import pytest
from pyspark.sql import functions as F

from ragframe.sources import frontier


def brute(seeds, quotas, links, keep, depth):
    """quotas: category -> (priority, quota)."""
    seen, out, room = set(), [], {c: q for c, (_, q) in quotas.items()}
    found = set(seeds)
    for level in range(depth + 1):
        if level:
            found = {(link, c) for u, c in last for link in links.get(u, ()) if keep(c, link) and link not in seen}  # noqa: F821
        owner = {}
        for u, c in found:
            if c in room and room[c] > 0 and (u not in owner or quotas[c][0] < quotas[owner[u]][0]):
                owner[u] = c
        last = [(u, c) for c in room for u in sorted(u for u, o in owner.items() if o == c)[: room[c]]]
        for u, c in last:
            seen.add(u)
            room[c] -= 1
        out += [(u, c, level) for u, c in last]
        if not last:
            break
    return sorted(out)


def tables(spark, rng):
    urls = [f"http://h{i % 4}.es/{i}" for i in range(60)]
    links = {u: [rng.choice(urls) for _ in range(4)] for u in urls}
    edges = spark.createDataFrame([(u, v) for u, vs in links.items() for v in vs] + [(urls[0], None)], "url string, link string")
    seeds = [(urls[0], "a"), (urls[0], "b"), (urls[1], "b"), (urls[2], "c")]
    quotas = {"a": (3, 8), "b": (1, 5), "c": (2, 30)}
    return links, edges, seeds, quotas, spark.createDataFrame(seeds, "url string, category string"), spark.createDataFrame([(c, *v) for c, v in quotas.items()], "category string, priority int, quota int")


KEEP = lambda c, u: not u.endswith("3") and not (c == "a" and u.endswith("4"))
KEEP_COLUMN = lambda c, u: ~F.endswith(u, F.lit("3")) & ~((c == "a") & F.endswith(u, F.lit("4")))


@pytest.mark.parametrize("seed", [1, 2])
def test_quotas_owners_and_slots(spark, tmp_path, seed):
    links, edges, seeds, quotas, s, q = tables(spark, random.Random(seed))
    rows = frontier.crawl(s, q, edges, KEEP_COLUMN, str(tmp_path / "c"), 5).collect()
    assert sorted((r.url, r.category, r.depth) for r in rows) == brute(seeds, quotas, links, KEEP, 5)
    for level, host in {(r.depth, r.host) for r in rows}:
        own = sorted((r.url, r.slot) for r in rows if (r.depth, r.host) == (level, host))
        assert [x for _, x in own] == list(range(len(own)))


def test_a_broken_level_is_made_again(spark, tmp_path):
    links, edges, seeds, quotas, s, q = tables(spark, random.Random(3))
    path = str(tmp_path / "c")
    frontier.crawl(s, q, edges, KEEP_COLUMN, path, 1)
    broken = tmp_path / "c" / "level=2"  # as a job leaves it that was stopped: rows, but no marker
    s.withColumn("depth", F.lit(2)).write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert frontier.levels(spark, path) == 2 and frontier.read(spark, path).filter("depth = 2").count() == 0
    rows = frontier.crawl(s, q, edges, KEEP_COLUMN, path, 5).collect()
    assert sorted((r.url, r.category, r.depth) for r in rows) == brute(seeds, quotas, links, KEEP, 5)
    again = frontier.crawl(s.limit(0), q, edges.limit(0), KEEP_COLUMN, path, 1)  # nothing is made anew
    assert sorted((r.url, r.category, r.depth) for r in again.collect()) == [r for r in brute(seeds, quotas, links, KEEP, 5) if r[2] <= 1]
    assert {r.after for r in frontier.schedule(again, 0.5).filter("slot = 0").collect()} == {0.0}


def test_no_seeds_and_no_room(spark, tmp_path):
    _, edges, _, _, s, q = tables(spark, random.Random(4))
    assert frontier.crawl(s.limit(0), q, edges, KEEP_COLUMN, str(tmp_path / "a"), 3).count() == 0
    assert frontier.crawl(s, q.withColumn("quota", F.lit(0)), edges, KEEP_COLUMN, str(tmp_path / "b"), 3).count() == 0
