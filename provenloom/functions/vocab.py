"""Vocabularies of procurement notices as data; pass another bundle for other languages."""

# The lists below decide results, and their order is the order of search.
PRICE_ANCHORS = (
    "начальная (максимальная) цена контракта",
    "начальная (максимальная) цена договора",
    "начальная (максимальная) цена",
    "цена договора составляет",
    "начальная(максимальная) цена контракта",
    "начальная максимальная цена контракта",
    "нмцк",
    "цена контракта составляет",
    "цена контракта:",
)
PRICE_FORBIDDEN = ("обеспечен",)
SECURITY_ANCHORS = (
    "размер обеспечения исполнения контракта",
    "размер обеспечения исполнения договора",
    "обеспечение исполнения контракта",
    "обеспечение исполнения договора",
    "обеспечения исполнения договора",
    "обеспечения исполнения контракта",
    "размер обеспечения исполнения",
)
SECURITY_FORBIDDEN = ("заявк", "гарантийн")
DEADLINE_ANCHORS = ("окончания подачи заявок", "окончание подачи заявок", "окончания срока подачи заявок", "дата и время окончания подачи")
SUBJECT_ANCHORS = ("объект закупки", "предмет закупки", "наименование объекта закупки")
CUSTOMER_ANCHORS = ("наименование заказчика", "заказчик:", "сведения о заказчике")
DURATION_ANCHORS = ("срок выполнения работ", "срок поставки товара", "срок поставки", "срок оказания услуг")
NEXT_LABELS = (
    "код позиции", "окпд", "место выполнения", "место поставки", "источник финансирования", "инн", "кпп", "контактное лицо", "основание проведения",
    "способ определения", "способ закупки", "наименование заказчика", "место нахождения", "адрес", "объект закупки", "начальная (максимальная)", "дата ", "срок ",
)
REQUIREMENT_MARKERS = ("должен", "должны", "обязан", "требовани", "наличие у участника", "участник закупки", "соответствие", "не менее", "предоставля", "гарантийный срок", "отсутствие")
CATEGORIES = (
    ("лицензии и допуски", ("саморегулируем", "сро", "лицензи", "разрешени", "удостоверен", "допуск", "реестр специалистов")),
    ("опыт", ("опыт", "исполненн", "за последние", "аналогичн", "ранее заключ")),
    ("квалификация персонала", ("специалист", "в штате", "квалифика", "образовани", "персонал")),
    ("материально-техническая база", ("оборудован", "техник", "материальн", "ресурс", "сервисн")),
    ("финансовые гарантии", ("обеспечен", "независим", "банковск", "залог")),
    ("требования к товару или работам", ("товар", "гост", "срок годности", "новым", "поставля", "гарантийный срок")),
)
OTHER_CATEGORY = "прочее"
OPTIONAL_MARKERS = ("вправе", "может быть", "по желанию", "рекомендуется")
EXECUTOR_WORDS = ("подрядчик", "поставщик", "исполнител", "участник")
CUSTOMER_WORDS = ("заказчик",)
PARTY = {"executor": "исполнитель", "customer": "заказчик", "both": "обе стороны", "none": "не указано"}
VAT = {"in": "включён", "out": "не включён", "none": "не указано"}
VAT_OUT, VAT_IN = ("не облагается", "без ндс"), ("в том числе ндс", "включая ндс")
LAW_44_NAME, LAW_223_NAME, LAW_UNKNOWN = "44-ФЗ", "223-ФЗ", "не определено"
PENALTY_FINE, PENALTY_INTEREST = "штраф", "пеня"
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
PAGE_MARKER = "[СТРАНИЦА {}]"
CONTINUED = "(продолжение предыдущего фрагмента)"

# Patterns in Java's dialect; (?iU) folds case and classes over Unicode.
SPACES = "\u00a0\u202f\u2009\u2007"
NUMBER = rf"\d(?:\d{{0,2}}(?:\.\d{{3}})+,\d{{1,2}}|\d{{0,2}}(?:[ {SPACES}]\d{{3}})+(?:[.,]\d{{1,2}})?|\d*(?:[.,]\d{{1,2}})?)"
MONEY = rf"(?iU)({NUMBER})\s*(?:\([^)]{{0,220}}\)\s*)?(?:руб(?:\.|лей|ля|ль)?|₽)"
PERCENT = rf"(?iU)({NUMBER})\s*(?:\([^)]{{0,80}}\)\s*)?(?:%|процент\w*)"
DATE_DIGITS = r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
DATE_WORDS = rf"(?iU)\b(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
LAW_44 = r"(?iU)(?<!\d)44[\s-]*фз|№\s*44-фз|федеральн\w+\s+закон\w*[^.]{0,40}(?<!\d)44"
LAW_223 = r"(?iU)223[\s-]*фз|№\s*223-фз"
NUMBER_19_OR_11 = r"(?U)\b(\d{19}|\d{11})\b"
INTEREST, FINE, FORFEIT = r"(?iU)\bпен[иеяю]", r"(?iU)\bштраф", r"(?iU)\bнеустойк"
FORMULA = r"(?iU)одной\s+тр(?:ё|е)хсотой|1/300|ключевой\s+ставк"
SENTENCE_END = r"(?U)(?<=[.;])\s+(?=[А-ЯЁ«\d])"
SENTENCE_END_LATIN = r"(?U)(?<=[.;])\s+(?=[A-Z\d])"
