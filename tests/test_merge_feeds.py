"""Feed resolution against feeds taken one after the other."""

import random

import pytest

from chronoweave.plans import merge_feeds as mf

FEEDS = "feed_pos int, path string, title string, link string"
PODCASTS = "id long, feed_url string, link string, title string"


def plain_assignment(feeds, podcasts):
    known = {}
    for pid, url, link, title in sorted(podcasts):
        for key in (url, link, title.lower() if title else None):
            if key and key.strip():
                known.setdefault(key.strip(), (pid, None))
    out = {}
    for pos, path, title, link in sorted(feeds):
        keys = [(link or "").strip(), (title or "").strip().lower(), path]
        hit = next((known[k] for k in keys if k and k in known), None)
        if hit is None:
            hit = (None, pos)
            for k in keys:
                if k:
                    known[k] = hit
        out[pos] = hit
    return out


def assigned(spark, feeds, podcasts):
    rows = mf.assign_podcasts(spark.createDataFrame(feeds, FEEDS), spark.createDataFrame(podcasts, PODCASTS)).collect()
    assert len(rows) == len(feeds)
    return {r.feed_pos: (r.podcast_id, r.leader) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_assignment_equals_feeds_in_turn(spark, seed):
    rng = random.Random(seed)
    feeds = [(i, rng.choice([f"/f{i}.xml", f"/f{rng.randrange(60)}.xml", "", None]), rng.choice([f"T{rng.randrange(40)}", " t3 ", None, ""]), rng.choice([f"l{rng.randrange(50)}", None, " l1"])) for i in range(120)]
    rng.shuffle(feeds)
    podcasts = [(7, "/f1.xml", "l2", "T5"), (9, "/f1.xml", "l3", "t5"), (8, None, "", None)]
    assert assigned(spark, feeds, podcasts) == plain_assignment(feeds, podcasts)


def test_a_chain_settles_in_few_rounds(spark, monkeypatch):
    # each feed shares its link with the one before and its title with the one behind
    feeds = [(i, f"/p{i}", f"k{i + 1}" if i % 2 else f"k{i}", f"k{i}" if i % 2 else f"k{i + 1}") for i in range(1000)]
    written, real = [], mf.cut_lineage
    monkeypatch.setattr(mf, "cut_lineage", lambda df: written.append(1) or real(df))
    assert assigned(spark, feeds, []) == plain_assignment(feeds, [])
    rounds = (len(written) - 4) / 2
    assert rounds <= 11


def test_copies_and_hot_keys_settle_at_once(spark, monkeypatch):
    feeds = [(i, f"/p{i}", "the same", f"l{i % 7}") for i in range(300)] + [(300 + i, "/one", None, None) for i in range(50)]
    written, real = [], mf.cut_lineage
    monkeypatch.setattr(mf, "cut_lineage", lambda df: written.append(1) or real(df))
    assert assigned(spark, feeds, []) == plain_assignment(feeds, [])
    assert (len(written) - 4) / 2 <= 3


def test_no_feeds(spark):
    assert assigned(spark, [], [(1, "a", "b", "c")]) == {}
