"""Fixed values.

Word lists, lookup tables, patterns and texts below are data the results depend
on; they are stated plainly and in their natural order, and nothing else in the
package repeats them.
"""

# Event types in display order, with their labels.
TYPE_LABELS = {
    "quiz": "Квиз",
    "standup": "Стендап",
    "bowling": "Боулинг",
    "billiards": "Бильярд",
    "karting": "Картинг",
    "concert": "Концерт",
    "theater": "Спектакль",
    "exhibition": "Выставка",
    "festival": "Фестиваль",
    "quest": "Квест",
    "party": "Вечеринка",
    "cinema": "Кино",
    "sport": "Спорт",
    "education": "Образование",
    "business": "Бизнес",
    "art": "Искусство",
    "kids": "Детям",
    "food": "Еда",
    "trip": "Экскурсии",
    "hobby": "Хобби",
    "science": "Наука",
    "other": "Другое",
}
EVENT_TYPES = list(TYPE_LABELS)

# Labels of permanent places and the label of any other place type.
VENUE_TYPE_LABELS = {
    "bowling": "Боулинг",
    "billiards": "Бильярд",
    "karting": "Картинг",
    "quest": "Квест",
}
VENUE_TYPE_FALLBACK = "Развлекательное место"

# Schema.org classes of place pages.
VENUE_SCHEMA_TYPES = {
    "bowling": "SportsActivityLocation",
    "karting": "SportsActivityLocation",
    "billiards": "SportsActivityLocation",
    "quest": "EntertainmentBusiness",
}
VENUE_SCHEMA_FALLBACK = "LocalBusiness"

# The marker of a place without a date.
ALWAYS = "always"
# Sources whose undated cards are extraction errors, and the types excepted.
SOCIAL_PREFIXES = ["vk-", "telegram-", "generic"]
PLACE_TYPES = ["bowling", "billiards", "karting", "quest"]

# Tags, their version and the tags given to a type that has none.
TAGS_VERSION = 1
ALLOWED_TAGS = [
    "для компании", "для пары", "для детей", "интеллектуальное", "активное",
    "творческое", "вечером", "днём", "в помещении", "на улице", "бесплатно",
]
DEFAULT_TAGS = {
    "quiz": ["интеллектуальное", "для компании"],
    "standup": ["для компании", "вечером"],
    "bowling": ["активное", "для компании", "в помещении"],
    "billiards": ["для компании", "в помещении"],
    "karting": ["активное", "для компании"],
    "concert": ["вечером"],
    "theater": ["вечером", "в помещении"],
    "exhibition": ["творческое", "в помещении"],
    "festival": ["для компании"],
    "quest": ["для компании", "интеллектуальное"],
    "party": ["для компании", "вечером"],
    "cinema": ["в помещении"],
    "kids": ["для детей"],
    "art": ["творческое"],
    "science": ["интеллектуальное"],
    "sport": ["активное"],
}

# Transliteration. Letters with several Latin letters come first.
TRANSLIT_MULTI = {
    "ё": "yo", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya",
}
TRANSLIT_SINGLE = ("абвгдезийклмнопрстуфхыэ", "abvgdeziyklmnoprstufhye")
TRANSLIT_DROPPED = "ъь"
SLUG_LENGTH = 80

# What makes a post look like an announcement.
EVENT_MARKERS = [
    "состоится", "билет", "регистраци", "вход", "начало", "когда:", "адрес:",
    "стоимость", "афиш", "приглашаем", "пройдёт", "пройдет",
]
TICKET_HOSTS = ["timepad.ru", "qtickets", "yandex.ru/afisha", "kassir", "ticketscloud"]
DATE_PATTERN = (
    r"\b\d{1,2}[\s.]*(январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)"
    r"|\b\d{1,2}[./]\d{1,2}\b"
    r"|\b\d{1,2}:\d{2}\b"
)

# Type keywords, tried in this order.
TYPE_KEYWORDS = [
    ("quiz", ["квиз", "quiz", "интеллектуальн"]),
    ("standup", ["стендап", "стэндап", "stand up", "standup", "стенд-ап"]),
    ("bowling", ["боулинг"]),
    ("billiards", ["бильярд"]),
    ("karting", ["картинг"]),
    ("concert", ["концерт"]),
    ("theater", ["театр", "спектакл"]),
    ("exhibition", ["выставк"]),
    ("festival", ["фестивал"]),
    ("quest", ["квест"]),
    ("party", ["вечеринк", "party", "пати"]),
    ("cinema", ["кино", "showing", "кинопоказ"]),
    ("education", ["мастер-класс", "мастер класс", "воркшоп", "workshop", "лекци"]),
    ("business", ["бизнес", "нетворкинг"]),
    ("sport", ["спорт", "турнир", "забег", "марафон"]),
    ("exhibition", ["выстав"]),
]

# Ticket feed category id to event type.
TICKET_CATEGORIES = {
    2335: "quiz", 460: "concert", 459: "theater", 458: "exhibition", 457: "party",
    374: "cinema", 376: "sport", 379: "kids", 217: "business", 452: "business",
    453: "education", 382: "education", 1315: "education", 2465: "science",
    456: "food", 461: "trip", 524: "hobby", 525: "art",
}
# Listing API category name to event type.
LISTING_CATEGORIES = {
    "concert": "concert", "theater": "theater", "exhibition": "exhibition",
    "festival": "festival", "quest": "quest", "party": "party",
}

# Schema.org types read as events, and the subtypes with a type of their own.
SCHEMA_EVENT_TYPES = [
    "Event", "TheaterEvent", "ComedyEvent", "MusicEvent", "SocialEvent", "Festival",
    "ExhibitionEvent", "ScreeningEvent", "EducationEvent", "SportsEvent", "BusinessEvent",
]
SCHEMA_TYPE_MAP = {
    "MusicEvent": "concert", "TheaterEvent": "theater", "ComedyEvent": "standup",
    "Festival": "festival", "ExhibitionEvent": "exhibition", "ScreeningEvent": "cinema",
    "EducationEvent": "education", "SportsEvent": "sport", "BusinessEvent": "business",
}
JSONLD_EVENT_PATTERN = r'"@type"\s*:\s*"[^"]*Event"'

# Links that name no event page, and hosts whose links are not kept.
JUNK_LINKS = ["", "#", "javascript:void(0)"]
JUNK_HOSTS = [
    "clck.ru", "vk.cc", "bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "is.gd",
    "taplink.ws", "taplink.cc", "goodsbuy.by",
]

# Domain sets of the source search.
IGNORED_DOMAINS = [
    "vk.com", "ok.ru", "t.me", "telegram.me", "youtube.com", "youtu.be", "instagram.com",
    "facebook.com", "dzen.ru", "yandex.ru", "google.com", "duckduckgo.com", "wikipedia.org",
    "2gis.ru", "avito.ru", "ticketland.ru", "kassir.ru", "kassy.ru", "afisha.ru",
    "tripadvisor.ru",
]
BUILDER_DOMAINS = [
    "tilda.ws", "tilda.cc", "wixsite.com", "ucoz.ru", "ucoz.net", "nethouse.ru", "bitrix24.site",
]
AGGREGATOR_DOMAINS = ["timepad.ru"]
AGGREGATOR_PENALTY = 5
EVENT_PATHS = ["/events", "/afisha", "/schedule", "/event", "/poster"]
LISTING_PATHS = ["/events", "/afisha", "/schedule", "/event", "/poster", "/raspisanie"]
PROBE_PATHS = ["", "/afisha", "/events", "/poster", "/raspisanie", "/schedule"]
SEARCH_PROVIDERS = ["serper", "brave", "duckduckgo"]
SEARCH_TEMPLATES = [
    "квиз {city}", "стендап {city}", "мастер-класс {city}", "детские мероприятия {city}",
    "афиша {city}", "экскурсии {city}", "фестиваль {city}", "куда сходить {city}",
]

# Opening-hours words that mark a line as a status, not an address.
STATUS_PATTERN = r"(закро|открыт|работ|круглосуточ|перерыв|обед|до открытия|временно|филиал)"
BRANCH_SUFFIX_PATTERN = r"\s*\d+\s+филиал[а-я]*\s*$"

# CSS classes of landed pages. They change with the sites; keep them here.
CHANNEL_CLASSES = {
    "message": "tgme_widget_message",
    "text": "tgme_widget_message_text",
    "link": "tgme_widget_message_date",
}
VENUE_CARD_CLASSES = {
    "card": ["_1kf6gff", "_5b28jpo"],
    "link": "_1rehek",
    "address": "_klarpw",
    "image": "_1dk5lq4",
}
PLAYBILL_MARKS = {
    "card": "event-card",
    "date": "event-date",
    "path": "/playbills/playbill/",
    "fallback_date": "data-calendar-date",
}

# Price texts and other texts shown to a reader.
PRICE_UNKNOWN = "уточняйте"
PRICE_FREE = "бесплатно"
PRICE_FREE_STEM = "беспл"
PRICE_FROM = "от %d ₽"
PRICE_RANGE = "от %d до %d ₽"
PRICE_FLAT = "%d ₽"
PRICE_ASK_ORGANIZER = "Уточняйте у организатора"
PRICE_BY_TICKET = "по билетам"
PRICE_BY_VENUE = "по тарифам заведения"
QUIZ_ORGANIZER = "QuizPlease"
NOT_AN_EVENT = "NOT_AN_EVENT"
SKIPPED_ALWAYS_TEXT = "Отброшено spurious 'always': %d"
DAILY = "ежедневно"
DAILY_DETAIL = "Доступно ежедневно"
FOUND_PREFIX = "Найдено: "
PLURAL_EVENTS = ("событие", "события", "событий")
PLACES_TITLE = "Площадки"
LISTING_TITLE = "Афиша"
MONTHS = [
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
]

# Cities — name, genitive and time zone.
CITY_NAMES = {"perm": "Пермь", "sochi": "Сочи"}
CITY_GENITIVE = {"perm": "Перми", "sochi": "Сочи"}
CITY_ZONES = {"perm": "Asia/Yekaterinburg", "sochi": "Europe/Moscow"}
DEFAULT_ZONE = "Europe/Moscow"
SOCIAL_OFFSET = "+03:00"

# Limits.
DESCRIPTION_LENGTH = 500
TITLE_LENGTH = 300
PRICE_TEXT_LENGTH = 80
MAP_SEARCH = "https://2gis.ru/search/"
POST_MARKER = "=== POST %s ===\n"
HTML_DROPPED_TAGS = ["script", "style", "noscript", "svg", "iframe", "head"]
HTML_TRUNCATED = "\n<!-- truncated -->"
MARKDOWN_DROPPED_TAGS = [*HTML_DROPPED_TAGS, "header", "footer", "nav", "aside"]
MARKDOWN_TRUNCATED = "\n\n<!-- truncated -->"
