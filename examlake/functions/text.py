"""Column functions over problem texts. All are built-in expressions; null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide results.
PUA = r"[\x{E000}-\x{F8FF}]"
SPACE = r"(?U)\s"
FIGURE_WORDS = r"(?U)(?:다음|아래|위)\s*(?:[와과]\s*같은\s*)?그림|그림\s*(?:[과와]\s*같이|에서|의)|(?:그래프|도형)\s*(?:[와과]\s*같이|에서)"
ANCHOR = r"(?U)^\s*(\d{1,3})\s*([.)])"
BOOK_ANCHOR = r"(?U)^\s*((기\s*본\s*문\s*제|유\s*제)\s*(\d{1,3})\s*[-\x{2010}-\x{2015}\x{2212}]\s*(\d{1,3}))(?!\d)"
BOOK_STRIDE = 1000
IMAGE_RATIO, CHARS_A_PAGE, USABLE_CHARS = 0.02, 50, 5
FOLLOWUPS = ("Follow-up Question", "Follow-up Questions", "꼬리 질문", "상세한 풀이 과정도 함께 제공해드릴까요")
MENTION = r"(?U)(?:(?:문제|문항)\s*|#\s*)(?<![\d.,])\d{1,3}|(?<![\d.,])\d{1,3}(?=\s*번)(?!\s*번째\s*(?:줄|행|칸|단계|글자|문자|쪽|페이지|장|항))"
ADD_INTENT = r"(?U)오답\s*노트[에]?\s*(?:.*?)(추가|담|넣|저장|등록)"
NOTE_NAME = r"(?U)([^\s,]{1,20})\s*(?:의)?\s*오답\s*노트"
NAME_STOPWORDS = ("이", "그", "저", "내", "제", "해당", "이번", "위", "아래", "문제", "문항", "오답")


def stripped(text: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def half_up(x: Column, digits: int) -> Column:
    """Rounded by floor(x * 10^n + 0.5), the same in any engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def pua_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\x{E000}-\x{F8FF}]", ""))


def solid_chars(text: Column) -> Column:
    """Characters other than white space."""
    return F.char_length(F.regexp_replace(text, SPACE, ""))


def pua_ratio(text: Column) -> Column:
    """Private-use characters among those that are not white space; 0.0 if there are none."""
    solid = solid_chars(text)
    return F.when(solid > 0, pua_chars(text) / solid).otherwise(0.0)


def document_mode(ratio: Column) -> Column:
    """P2."""
    return F.when(ratio >= IMAGE_RATIO, "image").otherwise("text")


def looks_scanned(text_chars: Column, pages: Column) -> Column:
    """Fewer than 50 characters a page; false without pages."""
    return (pages > 0) & (text_chars < CHARS_A_PAGE * pages)


def extract_error(problems: Column, scanned: Column, by_ocr: Column) -> Column:
    """Why a file gave no problems; null when it gave some."""
    return F.when(problems > 0, None).when(by_ocr, "ocr_no_anchor").when(scanned, "scanned").otherwise("no_anchor")


def anchor(text: Column) -> Column:
    """P5: no, delimiter, series and label of a line that begins a problem; null where none does."""
    book = F.regexp_replace(F.regexp_extract(text, BOOK_ANCHOR, 2), SPACE, "")
    number = lambda k: F.regexp_extract(text, BOOK_ANCHOR, k).cast("int")
    plain = F.regexp_extract(text, ANCHOR, 1)
    book_row = F.struct((number(3) * BOOK_STRIDE + number(4)).alias("no"), F.lit(None).cast("string").alias("delimiter"), book.alias("series"), F.regexp_extract(text, BOOK_ANCHOR, 1).alias("label"))
    plain_row = F.struct(plain.cast("int").alias("no"), F.regexp_extract(text, ANCHOR, 2).alias("delimiter"), F.lit(None).cast("string").alias("series"), plain.alias("label"))
    return F.when(book != "", book_row).when(plain != "", plain_row)


def normalized_for_hash(text: Column) -> Column:
    """Up to three leading numbers go, then all white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^(\s*\d+[.)]\s*){1,3}", ""), SPACE, "")


def content_hash(text: Column, image: Column | None = None) -> Column:
    """Of the normalised text, or of the image where that is empty; null for neither (a reject)."""
    normal = normalized_for_hash(F.coalesce(text, F.lit("")))
    other = F.lit(None).cast("string") if image is None else F.when(F.octet_length(image) > 0, F.sha2(image, 256))
    return F.when(normal != "", F.sha2(normal, 256)).otherwise(other)


def cleaned(text: Column) -> Column:
    """For display; null when nothing is left."""
    x = F.regexp_replace(text, r"(?![\n\t])[\x{E000}-\x{F8FF}\p{C}]", " ")
    x = F.regexp_replace(x, r"(?U)^\s*\d{1,2}\s*\.\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" *\n *", "\n")
    return F.nullif(stripped(x), F.lit(""))


def body_chars(text: Column) -> Column:
    """Characters of the body; a missing text has none."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[ \t]*\d+[ \t]*[).\]][ \t]*", "")
    return F.char_length(F.regexp_replace(x, r"(?U)[\s\x{E000}-\x{F8FF}\p{C}]", ""))


def usable(text: Column) -> Column:
    return body_chars(text) >= USABLE_CHARS


def needs_figure(text: Column) -> Column:
    """P10."""
    return F.coalesce(text.rlike(FIGURE_WORDS), F.lit(False))


def solve_input(mode: Column, text: Column, transcript: Column, source: Column, has_crop: Column) -> Column:
    """What a problem is solved from: mode (text, image or null), text and reason."""
    t, x = stripped(F.coalesce(transcript, F.lit(""))), stripped(F.coalesce(text, F.lit("")))
    row = lambda m, body, why: F.struct(F.lit(m).cast("string").alias("mode"), body.alias("text"), F.lit(why).alias("reason"))
    none = F.lit("")
    by_hand = F.coalesce(source == "manual", F.lit(False))
    return (
        F.when(has_crop & (t != "") & needs_figure(t), row("image", none, "figure"))
        .when(by_hand & usable(t), row("text", t, "manual"))
        .when((mode == "text") & usable(x), row("text", x, "original"))
        .when(usable(t), row("text", t, "transcript"))
        .when(has_crop, row("image", none, "crop"))
        .otherwise(row(None, none, "none"))
    )


def fallback_input(current: Column, transcript: Column, has_crop: Column) -> Column:
    """The other way, once."""
    t = stripped(F.coalesce(transcript, F.lit("")))
    return F.when(current == "text", F.when(has_crop, "image")).when(usable(t), "text")


def display_no(no: Column, label: Column) -> Column:
    """P13."""
    printed = stripped(F.coalesce(label, F.lit("")))
    return F.when((printed == "") | (printed == no.cast("string")), F.concat(no.cast("string"), F.lit("번"))).otherwise(printed)


def without_own_number(text: Column, no: Column) -> Column:
    """A leading number goes only if it is this problem's."""
    lead = r"^[ \t]*(\d+)[ \t]*[).\]][ \t]*"
    return F.when(F.regexp_extract(text, lead, 1) == no.cast("string"), F.regexp_replace(text, lead, "")).otherwise(text)


def export_name(file: Column, variants: Column, with_solutions: Column, fmt: Column) -> Column:
    """P15."""
    name = F.regexp_replace(file, r"(?i)\.pdf$", "")
    return F.concat(name, F.lit("_"), F.when(variants, "변형문제").otherwise("문제"), F.when(with_solutions, "와해설").otherwise(""), F.lit("."), fmt)


def without_followups(text: Column, markers: tuple[str, ...] = FOLLOWUPS) -> Column:
    """Cut from the first line with a marker, then blank lines and rules before it."""
    lines = F.split(text, r"\r\n|\n|\r")
    marked = lambda x: F.greatest(*(F.contains(F.lower(x), F.lit(m.lower())) for m in markers))
    at = F.array_position(F.transform(lines, marked), F.lit(True))
    kept = F.array_join(F.slice(lines, 1, F.greatest(at.cast("int") - 1, F.lit(0))), "\n")
    return F.when(at == 0, stripped(text)).otherwise(stripped(F.regexp_replace(kept, r"(\A|\n)([ \t]*([-_*][-_*]{2,})?[ \t]*(\n|\z))*\z", "")))


def recovered_json(text: Column) -> Column:
    """The object in a model's output as a map, and why there is none."""
    kind = "map<string,string>"
    whole, inner = F.from_json(text, kind), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), kind)
    value = F.coalesce(whole, inner)
    empty = F.coalesce(stripped(text) == "", F.lit(True))
    return F.struct(F.when(~empty, value).alias("value"), F.when(empty, "empty").when(value.isNull(), "bad_output").alias("reason"))


def mentions(text: Column, allowed: Column) -> Column:
    """Numbers of problems that a message names, in order, once each, only those of its exam."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), lambda m: F.regexp_extract(m, r"(\d+)$", 1).cast("int"))
    return F.array_intersect(found, allowed)


def note_intent(text: Column, allowed: Column) -> Column:
    """Whether a message asks to add to a note, which problems, and the note's name."""
    name = stripped(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, NOTE_NAME, 1), "[0-9#번째,]", ""), "의$", ""))
    adds = F.coalesce(text.rlike(ADD_INTENT), F.lit(False))
    wanted = F.when(adds & (name != "") & ~name.isin(*NAME_STOPWORDS), name)
    return F.struct(adds.alias("adds"), F.when(adds, mentions(text, allowed)).otherwise(F.array().cast("array<int>")).alias("numbers"), wanted.alias("note"))


def preview(text: Column, length: int = 60) -> Column:
    """P25: white space collapsed, the first characters."""
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(length))


def auto_title(text: Column, default: str, length: int = 30) -> Column:
    short = preview(text, length)
    return F.when(F.coalesce(short, F.lit("")) == "", default).otherwise(short)


def transcript_source(source: Column) -> Column:
    """P26."""
    return F.when(source.isin("pua", "ai", "manual"), source)


def instant(text: Column) -> Column:
    """ISO 8601; without an offset it is +09:00; blank or unreadable is null."""
    x = F.trim(text)
    whole = F.when(x.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(x, F.lit("T00:00:00"))).otherwise(x)
    zoned = F.when(whole.rlike(r"(Z|[+-]\d\d:?\d\d)$"), whole).otherwise(F.concat(whole, F.lit("+09:00")))
    return F.try_to_timestamp(zoned)
