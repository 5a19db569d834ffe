import random

import pytest
from pyspark.sql import functions as F

from eventloom import vocab
from eventloom.operators import cards as card_ops, merge
from eventloom.schemas import CARD, FILLABLE, ddl

PRI = {"tickets": 100, "vk-events": 80, "vk-posts": 40}
NOW = "2026-06-01 00:00:00"


def rows(spark, *cards):
    """Event rows out of short card descriptions, in arrival order."""
    defaults = dict(type="concert", price_min=0, price_max=0, price_text="уточняйте", address="ул. 1", tags=[])
    names = list(CARD)
    data = []
    for seq, card in enumerate(cards):
        full = {**defaults, **card}
        data.append(tuple(full.get(n) for n in names) + ("perm", full["source"], "http://u", seq))
    layout = f"{ddl(CARD)}, city string, source string, source_url string, seq bigint"
    return card_ops.to_event_rows(spark.createDataFrame(data, layout), F.lit(NOW).cast("timestamp"))


def card(title, date, venue, source, **more):
    return dict(title=title, date=date, venue_name=venue, source=source, **more)


HALL = ("Тихий вечер", "2025-03-01", "Зал у реки")


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_the_better_source_wins(spark, order):
    both = [card(*HALL, "vk-events"), card(*HALL, "tickets")]
    given = rows(spark, *(both[i] for i in order))
    only, = merge.merge_cards(given, None, PRI).collect()
    assert (only.source, only.reports) == ("tickets", 2)
    assert [tuple(p) for p in merge.merge_pairs(given, None, PRI).collect()] == [("vk-events", "tickets", 1)]


def test_gaps_are_filled_from_the_loser(spark):
    best = card(*HALL, "tickets", price_note="mine")
    rest = card(*HALL, "vk-posts", price_note="", image_url="https://i.example/7", organizer="Кружок", price_min=70,
                price_max=90, price_text="от 70 до 90 ₽")
    m, = merge.merge_cards(rows(spark, best, rest), None, PRI).collect()
    assert (m.source, m.image_url, m.organizer, m.price_min, m.price_max, m.price_note) == (
        "tickets", "https://i.example/7", "Кружок", 70, 90, "mine")


def test_repeats_of_one_source_are_no_merge(spark):
    given = rows(spark, card(*HALL, "vk-posts"), card(*HALL, "vk-posts", organizer="Кружок"))
    assert merge.merge_cards(given, None, PRI).count() == 1 and merge.merge_pairs(given, None, PRI).count() == 0


@pytest.mark.parametrize("new, old, winner", [
    ("vk-posts", "tickets", "tickets"), ("tickets", "vk-posts", "tickets"), ("unlisted", "unknown", "unlisted"), ("unlisted", "vk-posts", "vk-posts"),
])
def test_stored_and_incoming(spark, new, old, winner):
    stored = rows(spark, card(*HALL, old)).drop("seq")
    m, = merge.merge_cards(rows(spark, card(*HALL, new)), stored, PRI).collect()
    assert m.source == winner


def test_days_apart_and_near_misses(spark):
    apart = rows(spark, *(card(HALL[0], f"2025-03-0{d}", HALL[2], "tickets") for d in (1, 2, 3)))
    assert merge.merge_cards(apart, None, PRI).count() == 3
    near = rows(spark, card("Один", "2025-03-01", "Зал «У реки»", "vk-posts"), card("Другой", "2025-03-01", "зал у реки", "tickets"),
                card("Без места", "2025-03-01", "?!", "tickets"), card("Тоже", "2025-03-01", "--", "vk-posts"))
    assert merge.near_misses(near).collect()[0][0] == 1


def brute_force(reports, priorities):
    """The merge as a loop over groups of plain dictionaries."""
    out = {}
    groups = {}
    for r in reports:
        groups.setdefault(r["id"], []).append(r)
    for key, group in groups.items():
        best = max(priorities.get(r["source"], 0) for r in group)
        win = next(r for r in group if priorities.get(r["source"], 0) == best)
        rest = [r for r in group if r is not win]
        made = dict(win)
        for name in FILLABLE:
            if made[name] is None:
                made[name] = next((r[name] for r in rest if r[name] is not None), None)
        priced = [r for r in rest if r["price_min"] or r["price_max"]]
        if not (win["price_min"] or win["price_max"]) and priced:
            for name in ("price_min", "price_max", "price_text"):
                made[name] = priced[0][name]
            made["price_note"] = priced[0]["price_note"] or win["price_note"]
        made["tags"] = list(dict.fromkeys(t for r in [win, *rest] for t in r["tags"] if t in vocab.ALLOWED_TAGS))
        out[key] = made
    return out


def random_cards(n, seed, hot_share=1 / 3):
    """Cards of which one id holds a third."""
    rng = random.Random(seed)
    maybe = lambda value: value if rng.random() < 0.4 else None
    made = []
    for i in range(n):
        title = "Горячее" if rng.random() < hot_share else f"Событие {rng.randint(0, 40)}"
        price = rng.choice([0, 0, rng.randint(1, 900)])
        made.append(card(
            title, "2026-06-15", f"Зал {rng.randint(0, 5)}", rng.choice([*PRI, "unheard"]),
            time_start=maybe("19:00"), time_end=maybe(f"2{i % 4}:00"), image_url=maybe(f"http://i/{i}"),
            description=maybe(f"d{i}"), organizer=maybe(f"o{i}"), district=maybe(f"r{i}"),
            price_min=price, price_max=price and price + 5, price_text=f"p{i}",
            price_note=rng.choice([None, "", f"n{i}"]),
            tags=rng.sample(vocab.ALLOWED_TAGS, rng.randint(0, 3)),
        ))
    return made


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force_on_skewed_groups(spark, partitions):
    given = rows(spark, *random_cards(900, 3))
    want = brute_force(given.orderBy("seq").toPandas().to_dict("records"), PRI)
    got = merge.merge_cards(given.repartition(partitions), None, PRI).collect()
    assert len(got) == len(want)
    for row in got:
        for name in [*FILLABLE, "source", "price_min", "price_max", "price_text", "price_note"]:
            expected = want[row.id][name]
            assert row[name] == (None if expected != expected else expected), (row.id, name)
        assert row.tags == want[row.id]["tags"]


def test_merging_again_changes_nothing(spark):
    given = rows(spark, *random_cards(300, 5))
    once = merge.merge_cards(given, None, PRI).drop("reports")
    again = merge.merge_cards(given, once, PRI).drop("reports")
    assert sorted(map(str, once.collect())) == sorted(map(str, again.select(once.columns).collect()))
