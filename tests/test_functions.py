import random
import re
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from eventloom import vocab
from eventloom.functions import dates, predicates, prices, text, types, urls

BASE = "https://social.example/group"


def test_slug_examples(column):
    slug = lambda v: text.slugify(v, F.lit("2025-02-09"))
    assert column(slug, ["Джаз + Ужин: ночь №2", "x—y", " ¿Хор? "]) == ["dzhaz-uzhin-noch-o2-2025-02-09", "xy-2025-02-09", "hor-2025-02-09"]
    assert column(lambda v: text.slugify(v, F.lit("always")), ["Тир"]) == ["tir"]
    assert column(lambda v: text.slugify(v), ["ю" * 90]) == ["yu" * 40]


def plain_slug(title):
    letters = {**vocab.TRANSLIT_MULTI, **dict(zip(*vocab.TRANSLIT_SINGLE))}
    letters |= {c: "" for c in vocab.TRANSLIT_DROPPED}
    spelled = "".join(letters.get(c, c) for c in title.lower())
    ascii_only = unicodedata.normalize("NFKD", spelled).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "-", ascii_only).strip("-")[:80]


def test_slug_equals_a_plain_model(column):
    rng = random.Random(7)
    pool = [chr(c) for c in range(32, 0x530)] + list("№½ﬁ…™ⅧⅫ℡㎏①⑩ｆｕｌｌ𝐀𝟙 «»—")
    titles = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    every = [chr(c) for c in range(32, 0x2FFF)]
    titles += ["a" + "b".join(every[i : i + 12]) + "z" for i in range(0, len(every), 12)]
    assert column(lambda v: text.slugify(v), titles) == [plain_slug(t) for t in titles]


def test_slugs_of_ascii_and_cyrillic_titles_skip_the_class_of_rare_characters(column):
    assert column(text._expand, ["User 1", "Ёлка: ночь", "№5", "ночь Ⅷ", "", None]) == ["User 1", "Ёлка: ночь", "-o5", "ночь viii", "", None]
    # None of the skipped characters has a longer form.
    assert not [c for c in text._ascii_forms()[2] if ord(c) < 0x80 or 0x400 <= ord(c) <= 0x4FF]
    titles = [chr(c) + "1" for c in [*range(0x80), *range(0x400, 0x500)]]
    assert column(lambda v: text.slugify(v), titles) == [plain_slug(t) for t in titles]


def test_normal_form_and_fingerprint(column):
    assert column(text.normalize_text, ["  Ёлка: «Ночь», день_1! ", "..."]) == ["елка ночь день_1", ""]
    same = lambda v: text.fingerprint(v, F.lit("2026-06-15"), F.lit("Дом музыки"))
    a, b = column(same, ["Концерт «Икс»!", "концерт икс"])
    assert a == b and len(a) == 16


def test_visible_hash_ignores_scripts_and_markup(column):
    pages = [
        '<html><body class="x1"><script>t=1</script><p> Афиша  на\nмай </p></body></html>',
        '<html><body class="x2"><script>t=2</script><div>Афиша на май</div></body></html>',
        "<html><body><p>Афиша на июнь</p></body></html>",
    ]
    a, b, c = column(lambda v: text.content_hash(v, True), pages)
    assert a == b != c
    raw = column(lambda v: text.content_hash(v), pages)
    assert len(set(raw)) == 3


def test_event_links(column):
    useless = [None, "", " \t", *vocab.JUNK_LINKS, *(f"https://{host}/x1" for host in vocab.JUNK_HOSTS)]
    assert column(lambda v: urls.resolve_url(v, F.lit(BASE)), useless) == [BASE] * len(useless)
    kept = ["https://hall.example/show/9", "/poster/two", "three?x=1"]
    assert column(lambda v: urls.resolve_url(v, F.lit(BASE)), kept) == [urljoin(BASE, link) for link in kept]


@pytest.mark.parametrize("base", ["https://vk.com/p/q?x=1", "https://b.com", "http://h.example/a/b/c/"])
def test_url_join_equals_the_standard_library(column, base):
    links = ["/a/x", "../a/./b", "?q=1", "#f", "//h.ru/x", "x/y?z", "mailto:a@b.c", "./", "..", "g/../h",
             "http://x.ru/a", "../../../../g", "a//b", "/./x", "x/.", "", "y#s", "HTTP:z"]
    got = column(lambda v: urls.url_join(F.lit(base), v), links)
    want = [urljoin(base, link) for link in links]
    assert got[:-1] == want[:-1]


def test_domains(column):
    assert column(urls.domain_of, ["https://WWW.Ex.Ru:80/a", "//m.ex.ru?x", "no url", "https://www."]) == [
        "ex.ru:80", "m.ex.ru", None, None,
    ]
    listed = lambda v: urls.domain_in_set(v, ["kassir.ru", "afisha.yandex.ru"])
    assert column(listed, ["perm.Kassir.ru", "kassir.ru", "mykassir.ru", "yandex.ru", None]) == [
        True, True, False, False, False,
    ]
    wrapped = ["//d.example/l/?uddg=https%3A%2F%2Fex.ru%2Fa%3Fb%3D1&rut=2", "https://ex.ru/", "//d.example/l/?x=1"]
    assert column(urls.unwrap_redirect, wrapped) == ["https://ex.ru/a?b=1", "https://ex.ru/", "//d.example/l/?x=1"]


def test_dates(column):
    assert column(dates.padded_date, ["2026-6-5", "always", "soon", "2026-02-30"]) == ["2026-06-05", "always", None, None]
    assert column(dates.padded_time, ["9:05", "19:30", "25:00", "12"]) == ["09:05", "19:30", None, None]
    assert column(dates.iso_time_part, ["2026-06-15T19:00:00+0500", "2026-06-15", "2026-06-15T7"]) == ["19:00", None, None]
    assert column(dates.iso_to_unix, ["2026-06-13T12:00:00+00:00", "not-a-date", None]) == [1781352000.0, None, None]
    shown = column(lambda v: dates.format_event_date(v, F.lit("19:00"), F.lit("21:30")), ["2026-06-15", "always"])
    assert shown == ["15 июня, 19:00–21:30", "Доступно ежедневно"]


def test_prices(column):
    read = column(prices.price_from_text, ["от 1500 рублей", "", None, "Бесплатно", "1 000 - 2 500", "по записи"])
    assert [tuple(r) for r in read] == [
        (1500, 1500, "от 1500 рублей"), (0, 0, "уточняйте"), (0, 0, "уточняйте"), (0, 0, "бесплатно"),
        (1000, 2500, "1 000 - 2 500"), (0, 0, "по записи"),
    ]
    ranges = column(prices.price_range, [[500, None, 1500], [0], [300, 300], [None], [], None], "array<int>")
    assert [tuple(r) for r in ranges] == [
        (500, 1500, "от 500 до 1500 ₽"), (0, 0, "бесплатно"), (300, 300, "от 300 ₽"),
        (0, 0, "уточняйте"), (0, 0, "уточняйте"), (0, 0, "уточняйте"),
    ]
    assert column(prices.whole_price, ["1 500,70", "abc", "-", ""]) == [1500, None, None, None]


@pytest.mark.parametrize("day", [False, True])
@pytest.mark.parametrize("kind", ["social", "organizer", "aggregator"])
def test_announcements_need_a_sign(column, kind, day):
    plain, dated = "Просто мысли о погоде", "Собираемся 9 марта, билеты у входа"
    got = column(lambda v: predicates.is_event_candidate(v, kind), [dated if day else plain, "", None])
    assert [bool(x) for x in got] == [day, False, False]


@pytest.mark.parametrize("source", ["vk-events", "telegram-x", "generic", "generic:a.example", "twogis-x", "tickets"])
def test_spurious_undated_cards(spark, source):
    """Undated cards are spurious from sources of free text, unless the type is a place's."""
    free = source.split("-")[0].split(":")[0] in ("vk", "telegram", "generic")
    cases = [(date, kind, free and date == "always" and kind not in vocab.PLACE_TYPES)
             for date in ("always", "2025-02-09") for kind in vocab.EVENT_TYPES]
    rows = spark.createDataFrame(cases, "date string, type string, want boolean")
    test = predicates.is_spurious_always(F.col("date"), F.col("type"), F.lit(source))
    assert rows.filter(test != F.col("want")).count() == 0


def test_types_and_tags(column):
    assert column(types.infer_type, ["Большой КОНЦЕРТ", "Симпатичный вечер", "прогулка", None]) == [
        "concert", "party", "other", "other",
    ]
    kept = column(types.filter_tags, [["вечером", "чужой", "для пары", "вечером"]], "array<string>")
    assert kept == [["вечером", "для пары"]]
    assert column(lambda v: text.plural_ru(v), [1, 3, 5, 11, 21, 112], "int") == [
        "событие", "события", "событий", "событий", "событие", "событий",
    ]


def test_status_lines(column):
    lines = ["Временно не работает", "До открытия 40 мин.", "Колизей Атриум, ул. Ленина, 60"]
    assert column(predicates.is_status_line, lines) == [True, True, False]
