import json

from pyspark.sql import functions as F

from eventloom.operators.cards import validate_cards
from eventloom.sources import html_feeds, htmltree, json_feeds, structured

AS_OF = "2026-06-01"


def landed(spark, *contents, url="https://site.example/list/"):
    data = [("feed", "perm", url, c, i) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "source string, city string, url string, content string, page bigint")


def page(*events):
    return "".join(f'<script type="application/ld+json">{json.dumps(e, ensure_ascii=False)}</script>' for e in events)


EVENT = {
    "@type": "MusicEvent", "name": " Концерт ", "startDate": "2026-06-15T19:00:00+03:00",
    "endDate": "2026-06-15T21:30:00+03:00",
    "location": {"name": "Арена", "address": {"streetAddress": "ул. 1", "addressLocality": "Пермь"}},
    "offers": [{"price": "1 500,50"}, {"lowPrice": 300, "highPrice": True}], "url": "/e/1",
    "image": ["", {"url": "https://i/1.jpg"}], "organizer": [{"name": "Орг"}],
}


def test_structured_data(spark):
    other = {**EVENT, "@type": ["Thing", "Event"], "name": "Второе", "offers": {"price": 0}, "url": None, "@id": "#x"}
    deep = [[[[[{"@graph": [[{**EVENT, "name": "Глубоко"}]]}]]]]]
    content = page(EVENT, {"@graph": [{"@type": "WebSite"}, other]}, deep, {**EVENT, "location": None},
                   {**EVENT, "startDate": "скоро"}) + '<script type="application/ld+json">{bad</script>'
    read = structured.jsonld_events(landed(spark, content), "quiz").orderBy("seq").collect()
    assert [r.title for r in read] == ["Концерт", "Второе", "Глубоко"]
    first, second, _ = read
    assert (first.type, second.type) == ("concert", "quiz")
    assert (first.date, first.time_start, first.time_end) == ("2026-06-15", "19:00", "21:30")
    assert (first.price_min, first.price_max, first.price_text) == (300, 1500, "от 300 до 1500 ₽")
    assert second.price_text == "бесплатно"
    assert (first.address, first.image_url, first.organizer) == ("ул. 1, Пермь", "https://i/1.jpg", "Орг")
    assert (first.event_url, second.event_url) == ("/e/1", None)


def test_bad_items_cost_only_themselves(spark):
    values = [
        {"id": 1, "name": "Ярмарка", "starts_at": "2026-06-15T19:00:00+0500", "url": "https://t/1", "categories": {},
         "ticket_types": [{"price": 500.9}, {"price": "x"}, {"price": None}], "location": {"address": "ул. 2"}},
        {"id": 2, "name": "ab", "starts_at": "2026-06-15", "url": "https://t/2"},
        {"id": 3, "name": "Квиз", "starts_at": "2026-06-16", "url": "https://t/3", "location": "где-то",
         "categories": [{"id": 399}, {"id": 2335}]},
        "not an item", {"id": 4, "name": "Без ссылки", "starts_at": "2026-06-16"},
    ]
    read = json_feeds.ticket_events(landed(spark, json.dumps({"values": values}), "not json")).orderBy("seq").collect()
    assert [(r.title, r.type, r.price_text, r.address, r.time_start) for r in read] == [
        ("Ярмарка", "other", "от 500 ₽", "Пермь, ул. 2", "19:00"), ("Квиз", "quiz", "уточняйте", "Пермь", None),
    ]


def test_first_game_of_an_id_counts_even_when_unusable(spark):
    games = [{"id": "a", "title": "Игра", "date": "скоро"}, {"id": "a", "title": "Игра", "date": "15.06.2026 19:00"},
             {"title": "Без номера", "date": "15.06.2026 19:00"}, {"title": "Без номера", "date": "15.06.2026 19:00"}]
    raw = landed(spark, json.dumps({"data": {"data": games[:1]}}), json.dumps({"data": {"data": games[1:]}}))
    read = json_feeds.quiz_games(raw, "https://{city}.quiz.example").collect()
    assert [r.title for r in read] == ["Без номера", "Без номера"]
    assert {r.source_url for r in read} == {"https://perm.quiz.example/schedule"}


def test_channel_page(spark):
    html = """<div class="tgme_widget_message"><div class="tgme_widget_message_text">Квиз<br>в 19:00</div>
      <a class="tgme_widget_message_date" href="https://t.example/1"><time datetime="2026-06-13T12:00:00+00:00"></time></a></div>
      <div class="tgme_widget_message"><a class="tgme_widget_message_date" href="https://t.example/2"></a></div>"""
    read = html_feeds.channel_posts(landed(spark, html, "<html></html>")).collect()
    assert [(r.text, r.url, r.date_unix) for r in read] == [("Квиз\nв 19:00", "https://t.example/1", 1781352000.0)]


def test_place_cards(spark):
    html = """<div class="_1kf6gff"><a class="_1rehek"><span>Рокстар</span></a><div class="_klarpw">Закроется через час</div>
      <div class="_klarpw">шоссе Космонавтов, 111а  2 филиала</div>
      <div class="_1dk5lq4" style='background-image: image-set(url("https://i/1.jpg") 1x, url("https://i/2.jpg") 2x)'></div></div>
      <div class="_5b28jpo"><a class="_1rehek">Без адреса</a><div class="_klarpw">Круглосуточно</div></div>"""
    read = html_feeds.venue_cards_html(landed(spark, html + html), "bowling").collect()
    assert [(r.title, r.address, r.image_url, r.date) for r in read] == [
        ("Рокстар", "шоссе Космонавтов, 111а", "https://i/2.jpg", "always"),
    ]


def test_listing_links(spark):
    html = """<!-- <a href="/events/0"> --><a href="/events/1">1</a><a class='x' href='../events/2?a=1&amp;b=2'>2</a>
      <a href="/about">no</a><A HREF=/events/1>again</A><a href="https://other.example/events/3">3</a>"""
    read = html_feeds.listing_links(landed(spark, html), r"events/\d+").orderBy("seq").collect()
    assert [r.url for r in read] == [
        "https://site.example/events/1", "https://site.example/events/2?a=1&b=2", "https://other.example/events/3",
    ]


def test_cleaned_pages(spark):
    pages = [
        "<html><head><title>t</title></head><body><svg><path/></svg><p>a &amp b</P ><script>x</script></body></html>",
        "<html><head><title>t</title><body><noscript><p>kept", None, "plain",
        "<body><svg><svg>in</svg>left</svg><p>last</p></BODY> rest",
    ]
    raw = landed(spark, *pages)
    made = [r.content for r in html_feeds.clean_html(raw, "content").orderBy("page").collect()]
    assert made == ["<body><p>a &amp b</P ></body>", "<body><p>kept", "", "plain", "<body>left<p>last</p></BODY>"]
    cut = html_feeds.clean_html(raw, "content", max_chars=8).orderBy("page").collect()
    assert cut[0].content == "<body><p\n<!-- truncated -->" and cut[3].content == "plain"


def test_deep_pages_cost_nothing(spark):
    message = '<div class="tgme_widget_message">' + "<span>" * 5000 + '<div class="tgme_widget_message_text">deep</div>'
    root = htmltree.parse(message)
    assert [n.text() for n in root.all(cls="tgme_widget_message_text")] == ["deep"]
    assert sum(1 for _ in root.walk()) == 5002


def test_comments_hold_no_structured_data(spark):
    block = '<script type="application/ld+json">{"@type": "Event", "name": "%s"}</script>'
    page = "<!-- " + block % "hidden" + " -->" + block % "shown <!-- x -->" + (block % "no").replace("ld+json", "ld+jsonx")
    found = structured.jsonld_objects(landed(spark, page), ["page"])
    assert [r.name for r in found.select(F.try_variant_get("obj", "$.name", "string").alias("name")).collect()] == ["shown <!-- x -->"]


def test_answers(spark):
    good = {"title": "Концерт", "type": "concert", "date": "2026-6-5", "price_min": 0, "price_max": "100", "price_text": "x",
            "address": "ул. 1", "venue_name": "Зал", "time_start": "9:05", "tags": ["вечером", "чужой"]}
    items = [good, {**good, "price_max": -1}, {**good, "title": "NOT_AN_EVENT"}, {**good, "type": "ballet"}]
    raw = landed(spark, json.dumps({"events": items}), json.dumps(items), "oops")
    valid, rejected = validate_cards(json_feeds.model_responses(raw))
    assert [(r.date, r.time_start, r.price_max, r.tags) for r in valid.collect()] == [("2026-06-05", "09:05", 100, ["вечером"])] * 2
    assert sorted(tuple(r.failed) for r in rejected.collect()) == [
        ("price_max_negative", "price_order")] * 2 + [("type_unknown",)] * 2


def test_listing_api_needs_a_day_ahead(spark):
    item = {"title": "Выставка", "dates": [{"start_date": "2026-05-01"}, {"start_date": "2026-06-20", "start_time": "12:00:00"}],
            "place": {"title": "Музей", "address": "ул. 3"}, "site_url": "https://k/1", "price": "от 200"}
    raw = landed(spark, json.dumps({"results": [item, {**item, "dates": item["dates"][:1]}, {**item, "place": None}]}))
    read = json_feeds.listing_api_events(raw, F.lit(AS_OF).cast("date")).collect()
    assert [(r.date, r.time_start, r.price_min) for r in read] == [("2026-06-20", "12:00", 200)]
