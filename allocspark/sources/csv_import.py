"""CSV exports into typed allocation and mass-casualty rows, and rejects.

Reading is Spark's; the driver looks only at each file's first bytes (through the store's
own file system, so any store will do) for its encoding and header. Everything after that
is columns, but for trimming and Unicode normalisation, which Arrow does batch by batch.
"""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_records import parsed, records

#: Spellings of a header's letters, signals of a row's type, words for true and false.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
MASS_SIGNALS = ("manv", "manv_id")
ALLOCATION_SIGNALS = ("datum_erstellungsdatum", "uhrzeit_erstellungsdatum", "pzc", "pzc_und_text", "fachgebiet", "fachbereich", "grund", "dringlichkeit")
TRUE_WORDS, FALSE_WORDS = ("ja", "j", "1", "wahr", "x", "schwanger"), ("nein", "n", "0", "falsch", "false")
#: Flags of allocations by their columns; mass-casualty rows have all but the last two.
FLAGS = {"requires_resus": "schockraum", "requires_cathlab": "herzkatheter", "is_cpr": "reanimation", "is_ventilated": "beatmet", "is_shock": "schock", "is_pregnant": "schwanger", "is_with_physician": "arztbegleitet", "is_work_accident": "arbeits_wege_schulunfall", "department_was_closed": "fachbereich_war_abgemeldet"}
#: Plain texts by their columns.
TEXTS = {"hospital": "krankenhaus_kurzname", "speciality": "fachgebiet", "department": "fachbereich", "assignment": "grund", "occasion": "anlass", "secondary_transport": "sekundaeranlass", "secondary_indication": "neben_pzc_text", "case_id": "enr", "notes": "freitext", "mci_title": "manv", "mci_id": "manv_id"}
NO_INFECTION = ("Keine", "k.A.")
#: The mark of a coordinating body, and what is cut from and corrected in a dispatch area's name.
COORDINATION = "Koordinierungsstelle"
AREA_CUTS = (r"^Leitstelle\s+", r"^Kreis\s+", r"\s*\(.+$", r"\s*-\s*Kreis$", r"\s*Kreis$")
AREA_TYPOS = {"Groá-Gerau": "Groß-Gerau"}
#: Departments by other names.
DEPARTMENT_ALIASES = {"perinatalzentrum level 1": "geburtshilfe", "perinataler schwerpunkt": "geburtshilfe", "geburtsklinik": "geburtshilfe"}
GROUND, AIR = ("boden", "naw", "itw", "mzf", "rtw"), ("luft",)
#: The words of the four assessments; others stay as they are.
ASSESSMENTS = {
    "airway": {"free": ("frei",), "risk": ("gefährdet", "gefaehrdet"), "intubated": ("intubiert",), "critical": ("krit. atemweg", "kritischer atemweg", "krit atemweg", "kritisch", "krit.", "krit")},
    "breathing": {"spontaneous": ("spontan",), "insufficient": ("resp. insuff.", "resp insuff.", "resp. insuff", "resp insuff", "respiratorische insuffizienz", "kritisch", "krit.", "krit"), "cpap": ("cpap", "flow-cpap", "flow cpap"), "niv": ("niv",), "invasive": ("invasiv",)},
    "circulation": {"stable": ("stabil",), "medication": ("stabil unter med.", "stabil u. med.", "stabil unter med", "katecholamin", "katecholamine"), "unstable": ("instabil", "kritisch", "krit.", "krit"), "cpr": ("laufende rea", "rea laufend", "laufende reanimation")},
    "disability": {"awake": ("wach",), "sedated": ("sediert",), "anesthetized": ("narkotisiert",)},
}
MARK = "\ufeff"
BLANK = " \t\n\r\0\x0b"
HEAD_BYTES = 8192


def detected_encoding(head: bytes) -> str:
    """From the first bytes of a file; an empty one is an error."""
    if not head:
        raise ValueError("empty file")
    try:
        head.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        cut_short = e.start >= len(head) - 3 and e.reason == "unexpected end of data"
        return "UTF-8" if cut_short else "ISO-8859-1"


def normalized_header(cells: list[str]) -> list[str]:
    """Column names: lower case, umlauts written out, other signs as _, unnamed by place, repeated ones numbered."""
    names: list[str] = []
    for place, cell_ in enumerate(cells, 1):
        low = unicodedata.normalize("NFC", cell_.lstrip("﻿").strip()).lower()
        name = re.sub(r"[^a-z0-9]+", "_", "".join(UMLAUTS.get(c, c) for c in low)).strip("_") or f"col_{place}"
        same = sum(n == name or re.fullmatch(rf"{re.escape(name)}_\d+", n) is not None for n in names)
        names.append(f"{name}_{same + 1}" if same else name)
    return names


def heads(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The first bytes of each file of a path (a file, a folder or a pattern)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    store, found = place.getFileSystem(conf), {}
    for status in store.globStatus(place) or []:
        inner = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        for f in inner:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                stream = store.open(f.getPath())
                found[f.getPath().toString()] = bytes(stream.readNBytes(HEAD_BYTES))
                stream.close()
    return found


def trimmed(df: DataFrame) -> DataFrame:
    """All text columns but _file without a byte order mark in front and blanks around them, in Unicode's composed form (NFC); rows without any text are left out."""
    own = [n for n, kind in df.dtypes if kind == "string" and n != "_file"]

    def whole(column: pa.Array) -> pa.Array:
        if pc.any(pc.starts_with(column, MARK)).as_py():
            column = pc.replace_substring_regex(column, f"^{MARK}", "")
        column = pc.utf8_trim(column, BLANK)
        if pc.all(pc.string_is_ascii(column)).as_py() is not False:
            return column
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            batch = pa.RecordBatch.from_arrays([whole(c) if n in own else c for n, c in zip(names, batch.columns, strict=True)], names)
            some = [pc.fill_null(pc.greater(pc.binary_length(batch.column(n)), 0), False) for n in own]
            yield batch.filter(reduce(pc.or_, some))

    return df.mapInArrow(run, df.schema)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All cells as trimmed text under normalised names, with _file and _line; rows without any text are left out.

    Files may differ in encoding and header. Quoted cells may hold line breaks; a file is read by
    as many tasks as it has splits all the same (``csv_records``), and _line is the line in the file
    on which a record begins. Rows are cut or filled up to the header's width.
    """
    groups: dict[tuple, list[str]] = {}
    for name, head in heads(spark, path).items():
        encoding = detected_encoding(head)
        first = next(csv.reader(head.decode(encoding, "replace").splitlines(), delimiter=";"))
        groups.setdefault((encoding, tuple(first)), []).append(name)
    if not groups:
        raise ValueError(f"no file in {path}")
    parts = []
    for (encoding, first), files in groups.items():
        names = normalized_header(list(first))
        parts.append(parsed(records(spark, files).where("_line > 1"), names, encoding))
    return trimmed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def cell(df: DataFrame, name: str) -> Column:
    """A column's text, null where it is blank or missing."""
    return F.nullif(F.btrim(F.col(name), F.lit(BLANK)), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def row_type(df: DataFrame) -> Column:
    """MCI_CASE, ALLOCATION or null, by the first signal that isn't blank."""
    some = lambda names: F.coalesce(*[cell(df, n) for n in names]).isNotNull()
    return F.when(some(MASS_SIGNALS), F.lit("MCI_CASE")).when(some(ALLOCATION_SIGNALS), F.lit("ALLOCATION"))


def boolean(text: Column) -> Column:
    """By a plus or minus at the end, or a word; null for others."""
    return _yes_or_no(F.lower(F.btrim(text, F.lit(BLANK))))


def _yes_or_no(low: Column) -> Column:
    return F.when(low.endswith("+"), True).when(low.endswith("-"), False).when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def moment(date: Column, time: Column) -> Column:
    """Day.month.year (of two digits from 70 on in the last century) and a time cut to minutes; null if they are none."""
    parts = F.split(F.btrim(date, F.lit(BLANK)), r"\.")
    last = F.get(parts, F.lit(2))
    year = F.when(F.length(last) == 2, F.concat(F.when(last >= "70", F.lit("19")).otherwise(F.lit("20")), last)).otherwise(last)
    iso = F.concat_ws("-", year, F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.when(F.size(parts) == 3, F.try_to_timestamp(F.concat_ws(" ", iso, F.substring(time, 1, 5)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))


def number(text: Column) -> Column:
    """The whole part of a number; null for other texts."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("int"))


def area_name(text: Column) -> Column:
    """A dispatch area's name without its usual additions."""
    for pattern in AREA_CUTS:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_extract(text, r"^\s*(.*\S)\s*$", 1)
    for wrong, right in AREA_TYPOS.items():
        text = F.regexp_replace(text, f"^{re.escape(wrong)}$", right)
    return text


def gender(text: Column) -> Column:
    """M; W is F; anything else, and nothing, is X."""
    return F.when(F.upper(text) == "M", "M").when(F.upper(text) == "W", "F").otherwise("X")


def transport(text: Column) -> Column:
    """G or A by a whole word; null for others."""
    return _ground_or_air(F.lower(text))


def _ground_or_air(low: Column) -> Column:
    return F.when(low.isin(*GROUND), "G").when(low.isin(*AIR), "A")


def unlettered(text: Column) -> Column:
    """An assessment without its letter in front; null where nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(text, r"^(?i)[A-D]-", ""), F.lit(BLANK)), F.lit(""))


def assessment(kind: str, plain: Column, low: Column | None = None) -> Column:
    """A word of the assessment's vocabulary by its synonyms; other texts stay. low: the text in lower case, where that is known."""
    low = F.lower(plain) if low is None else low
    out = None
    if kind == "disability":
        out = F.when(low.rlike(r"^gcs\s*<\s*15$"), "gcs_below_15").when(low.rlike(r"^gcs\s*<\s*9$"), "gcs_below_9")
    for word, synonyms in ASSESSMENTS[kind].items():
        out = F.when(low.isin(*synonyms), word) if out is None else out.when(low.isin(*synonyms), word)
    return out.otherwise(plain)


def collapsed(text: Column) -> Column:
    """The form in which names are compared."""
    return F.lower(F.regexp_replace(F.btrim(text, F.lit(BLANK)), r"\s+", " "))


def indication_key(code: Column, text: Column) -> Column:
    """md5 of three digits and the collapsed text; no digits are none."""
    digits = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D+", "")
    three = F.when(digits == "", F.lit("")).otherwise(F.lpad(F.substring(digits, 1, 3), 3, "0"))
    return F.md5(F.concat(three, F.lit("_"), F.coalesce(collapsed(text), F.lit(""))).cast("binary"))


def case_hash(text: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of a case id's digits; null without any. Two nested digests, as the construction says, so no Python runs."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    digits = F.regexp_replace(text, r"\D+", "")
    hashed = F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), digits.cast("binary")), 256))), 256))
    return F.when(digits != "", hashed)


def _once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Columns that are computed once: exploded from an array of one, so that later filters use the values instead of repeating their making."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("c")).select("c.*")


#: Columns that rules look at beside texts, flags and assessments.
OTHERS = ("zuweisung_durch", "versorgungsbereich", "datum_erstellungsdatum", "uhrzeit_erstellungsdatum", "datum_eintreffzeit", "uhrzeit_eintreffzeit", "geschlecht", "alter", "transportmittel", "pzc", "pzc_und_text", "neben_pzc", "ansteckungsfaehig")


def _cleaned(df: DataFrame) -> DataFrame:
    """All cells that rules look at, trimmed, null where blank or missing, the raw row as JSON, and in lower case (low_) those that are compared with many words."""
    raw = [n for n in df.columns if not n.startswith("_")]
    places = [F.col(n) for n in ("_file", "_line") if n in df.columns]
    cells = [cell(df, n).alias(n) for n in dict.fromkeys((*OTHERS, *TEXTS.values(), *FLAGS.values()))]
    clean = _once(df, [*cells, *[unlettered(cell(df, k)).alias(k) for k in ASSESSMENTS], F.to_json(F.struct(*raw)).alias("row"), *places])
    return _once(clean, [*[F.col(n) for n in clean.columns], *[F.lower(n).alias(f"low_{n}") for n in ("transportmittel", *FLAGS.values(), *ASSESSMENTS)]])


def _common(df: DataFrame, flags: dict[str, str], missing: bool | None) -> list[Column]:
    c = F.col
    source = F.when(c("zuweisung_durch").isNull() | c("zuweisung_durch").contains(COORDINATION), c("versorgungsbereich")).otherwise(c("zuweisung_durch"))
    code = lambda n: F.when(c(n).rlike(r"^\d{6}$"), F.substring(c(n), 1, 3).try_cast("int"))
    last = F.substring(c("pzc"), 6, 1)
    infection = c("ansteckungsfaehig")
    return [
        *[c(v).alias(k) for k, v in TEXTS.items()], area_name(source).alias("dispatch_area"),
        moment(c("datum_erstellungsdatum"), c("uhrzeit_erstellungsdatum")).alias("created_at"), moment(c("datum_eintreffzeit"), c("uhrzeit_eintreffzeit")).alias("arrival_at"),
        number(c("alter")).alias("age"), _ground_or_air(c("low_transportmittel")).alias("transport_type"),
        F.when(c("pzc").rlike(r"^\d{6}$") & last.isin("1", "2", "3"), last.try_cast("int")).alias("urgency"), code("pzc").alias("code"), F.expr("substring(pzc_und_text, 5)").alias("indication"), code("neben_pzc").alias("secondary_code"),
        F.when(~infection.isin(*NO_INFECTION), infection).alias("infection"),
        *[F.when(c(v).isNull(), F.lit(missing).cast("boolean")).otherwise(_yes_or_no(c(f"low_{v}"))).alias(k) for k, v in flags.items()],
        *[assessment(k, c(k), c(f"low_{k}")).alias(f"assessment_{k}") for k in ASSESSMENTS], c("row"), *[c(n) for n in ("_file", "_line") if n in df.columns],
    ]


def allocations(df: DataFrame) -> DataFrame:
    """Typed columns of allocation rows beside the raw row as JSON. A missing flag is false, an unknown word none."""
    clean = _cleaned(df)
    return _once(clean, [*_common(clean, FLAGS, False), gender(F.col("geschlecht")).alias("gender")]).drop("mci_title", "mci_id")


def mass_casualties(df: DataFrame) -> DataFrame:
    """Typed columns of mass-casualty rows: flags and gender may be missing."""
    flags, clean, text = dict(list(FLAGS.items())[:-2]), _cleaned(df), F.col("geschlecht")
    return _once(clean, [*_common(clean, flags, None), F.when(text.isNotNull(), gender(text)).alias("gender")])


def routed(df: DataFrame) -> dict[str, DataFrame]:
    """Rows by their type; those of none are rejects."""
    typed = df.withColumn("_type", row_type(df))
    return {"allocations": typed.where("_type = 'ALLOCATION'").drop("_type"), "mass_casualties": typed.where("_type = 'MCI_CASE'").drop("_type"), "untyped": typed.where("_type IS NULL").drop("_type")}


#: What must hold: field, reason, condition under which a row is wrong.
RULES = (
    ("hospital", "must not be blank", "hospital IS NULL"), ("dispatch_area", "must not be blank", "dispatch_area IS NULL OR dispatch_area = ''"), ("created_at", "must be a date and a time", "created_at IS NULL"), ("arrival_at", "must be a date and a time", "arrival_at IS NULL"),
    ("arrival_at", "must not be before created_at", "arrival_at < created_at"), ("age", "must be between 1 and 99", "age IS NULL OR age NOT BETWEEN 1 AND 99"), ("urgency", "must be between 1 and 3", "urgency IS NULL"),
    ("code", "must be between 100 and 999", "code IS NULL OR code NOT BETWEEN 100 AND 999"), ("indication", "must not be blank", "indication IS NULL OR trim(indication) = ''"), ("secondary_code", "must be between 100 and 999", "secondary_code NOT BETWEEN 100 AND 999"),
    ("speciality", "must not be blank", "speciality IS NULL"), ("department", "must not be blank", "department IS NULL"), ("assignment", "must not be blank", "assignment IS NULL"), ("notes", "must have 255 characters at most", "length(notes) > 255"),
    *((name, "must be yes or no", f"{name} IS NULL") for name in FLAGS),
)


def messages() -> Column:
    """Everything that is wrong with a typed row: field, reason and the typed value as text."""
    return F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(f).alias("field"), F.lit(m).alias("reason"), F.col(f).cast("string").alias("value"))) for f, m, c in RULES]))


def validated(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with their messages and the raw row."""
    checked = typed.select("*", F.explode(F.array(messages())).alias("messages"))
    places = [c for c in ("_file", "_line") if c in typed.columns]
    return checked.where("size(messages) = 0").drop("messages"), checked.where("size(messages) > 0").select("messages", "row", *places)


def said(messages_: Column) -> Column:
    """Messages as one text."""
    return F.array_join(F.transform(messages_, lambda m: F.concat(m["field"], F.lit(": "), m["reason"])), " | ")


#: Bytes of a reference table up to which every task gets it whole; larger ones are joined by a shuffle with salts.
SMALL, SALTS = 8 << 20, 16


def resolved(rows: DataFrame, reference: DataFrame, name: str, out: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The id of a reference table's entry (id, name) of the same name but for case and blanks, or of its alias; null without one.

    Names are few and each may have very many rows. A reference table of up to SMALL bytes, by
    its measured names, goes to every task; a larger one meets the rows by name and a salt.
    """
    known = reference.groupBy(collapsed(F.col("name")).alias("_key")).agg(F.min("id").alias(out))
    key = collapsed(F.col(name))
    if aliases:
        meant = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        key = F.coalesce(F.element_at(meant, F.col("_key")), F.col("_key"))
        keyed = rows.withColumn("_key", collapsed(F.col(name))).withColumn("_key", key)
    else:
        keyed = rows.withColumn("_key", key)
    size = known.agg(F.coalesce(F.sum(F.octet_length("_key") + 16), F.lit(0)).alias("n")).first()["n"]
    if size <= SMALL:
        return keyed.join(F.broadcast(known), "_key", "left").drop("_key")
    salted = known.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], "left").drop("_key", "_salt")


def referenced(rows: DataFrame, references: dict[str, tuple[DataFrame, dict[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """Rows with an id for each named field that isn't null, and rejects with a field whose name nobody knows. references: field -> (table, aliases)."""
    for field, (table, aliases) in references.items():
        rows = resolved(rows, table, field, f"{field}_id", aliases)
    lost = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & F.col(f"{f}_id").isNull(), F.struct(F.lit(f).alias("field"), F.lit("is not known").alias("reason"), F.col(f).alias("value"))) for f in references]))
    checked = rows.select("*", F.explode(F.array(lost)).alias("messages"))
    places = [c for c in ("_file", "_line") if c in rows.columns]
    return checked.where("size(messages) = 0").drop("messages"), checked.where("size(messages) > 0").select("messages", "row", *places)


def with_raw_indications(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the keys of their raw indications and the normalised ids that those have, and the raw indications that are new.

    known: raw_key, normalized_id. A secondary one needs a code and a text.
    """
    second = F.col("secondary_code").isNotNull() & (F.coalesce(F.trim("secondary_indication"), F.lit("")) != "")
    rows = rows.withColumns({"raw_key": F.when(F.col("code").isNotNull() & F.col("indication").isNotNull(), indication_key(F.col("code"), F.col("indication"))), "secondary_raw_key": F.when(second, indication_key(F.col("secondary_code"), F.col("secondary_indication")))})
    both = rows.select(F.expr("stack(2, raw_key, code, indication, secondary_raw_key, secondary_code, secondary_indication) AS (raw_key, code, name)")).where("raw_key IS NOT NULL")
    new = both.groupBy("raw_key").agg(F.min(F.struct("name", "code")).alias("n")).select("raw_key", "n.code", "n.name").join(known, "raw_key", "left_anti")
    first, other = (known.select(F.col("raw_key").alias(k), F.col("normalized_id").alias(v)) for k, v in (("raw_key", "indication_id"), ("secondary_raw_key", "secondary_indication_id")))
    return rows.join(first, "raw_key", "left").join(other, "secondary_raw_key", "left"), new


def reject_groups(rejects: DataFrame) -> DataFrame:
    """Messages by field, value and reason: how many, and the least example; most frequent first."""
    m = rejects.select(F.explode("messages").alias("m"), "row").select("m.*", "row")
    return m.groupBy("field", "value", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("example")).orderBy(F.desc("n"), "field", "value", "reason")


def rejects_markdown(groups: DataFrame) -> DataFrame:
    """The groups as lines of a Markdown table."""
    text = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return groups.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[text(c) for c in ("field", "value", "reason", "n")]), F.lit(" |")).alias("line"))


def write_rejects(rejects: DataFrame, path: str, kind: str = "csv") -> None:
    """Rejects with their place, messages and raw row, as CSV (no cell is a formula), JSON or Parquet."""
    places = [F.col(c).alias(c.strip("_")) for c in ("_file", "_line") if c in rejects.columns]
    flat = rejects.select(*places, escaped(said(F.col("messages"))).alias("messages"), (escaped(F.col("row")) if kind == "csv" else F.col("row")).alias("row"))
    flat.write.format(kind).options(**({"header": True, "escape": '"'} if kind == "csv" else {})).save(path)


def outcome(total: int, rejected: int) -> str:
    """completed below 5 % rejects, failed from 35 % on or without rows, else partial."""
    if not total or rejected / total >= 0.35:
        return "failed"
    return "completed" if rejected / total < 0.05 else "partial"


def escaped(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
