"""Personal-data scans, text audits, reference matching, snapshots and small-cell safeguards."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import identifiers as I
from tallyspark.functions.columns import as_list, strip_space
from tallyspark.operators.describe import unpivot_text
from tallyspark.operators.similar import ratio, similar_pairs
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table

# Column names that usually hold names, contacts or identifiers, and codes that are not names.
HEADER_WORDS = (
    "name", "first name", "last name", "surname", "full name", "contact", "customer", "client", "company", "firm", "owner",
    "address", "street", "e-mail", "email", "phone", "mobile", "telephone", "birth", "passport", "national id", "tax id", "iban",
    "ad", "adı", "soyad", "soyadı", "isim", "müşteri", "firma", "şirket", "adres", "telefon", "doğum", "tc kimlik", "tckn", "vergi no",
    "név", "vezetéknév", "keresztnév", "ügyfél", "cég", "cím", "születési", "adóazonosító", "taj",
    "nome", "cognome", "cliente", "azienda", "indirizzo", "telefono", "codice fiscale",
    "نام", "نام خانوادگی", "مشتری", "شرکت", "آدرس", "تلفن", "کد ملی",
)
NEUTRAL_CODES = (
    "y", "n", "u", "yes", "no", "unknown", "true", "false", "pass", "fail", "hold", "held", "na", "n/a", "none", "missing", "other",
    "pending", "human pending", "user decision", "not documented", "not reviewed", "complete", "completed", "not applicable",
)
KINDS = {
    "email": "e-mail address", "phone": "phone number", "iban": "bank account (IBAN)", "tckn": "Turkish ID number (TCKN)", "hu_tax": "Hungarian tax ID", "card": "payment card number",
    "amount": "exact amount", "invoice": "invoice or order number", "listed": "listed name", "labelled": "person name (labelled field)",
}
HIGH = ("email", "phone", "iban", "tckn", "hu_tax", "card", "listed", "labelled")


def cell_kinds(value: Column) -> dict[str, Column]:
    """Kinds of personal data a table cell looks like; false for a blank cell."""
    s = strip_space(value)
    d = I.digits_only(s)
    numeric = s.rlike(I.CELL_NUMBERLIKE)
    phone = s.rlike(I.CELL_PHONE) & F.length(d).between(9, 15) & ~s.rlike(I.CELL_DECIMAL)
    up = F.upper(s)
    flags = {
        "email": s.rlike(I.CELL_EMAIL), "phone": phone, "iban": F.when(up.rlike(I.IBAN), I.iban_ok(F.regexp_extract(up, I.IBAN, 0))),
        "tckn": F.when(numeric & (F.length(s) <= 14), I.tckn_ok(d)), "hu_tax": F.when(numeric & (F.length(s) <= 13), I.hu_tax_ok(d)),
        "card": F.when(numeric & (F.length(s) <= 23) & ~phone, I.luhn_ok(d))}
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def header_hint(column: str) -> bool:
    """Whether a column name suggests names, contacts or identifiers."""
    flat = lambda x: re.sub(r"[_\-.]+", " ", x).strip().lower()
    name = flat(column)
    words = set(name.split())
    return any((w in name) if " " in w else (w in words) for w in map(flat, HEADER_WORDS))


@analysis("personal_data_scan", "Personal-data scan", "Privacy")
def personal_data_scan(df: DataFrame, columns=None) -> DataFrame:
    """Findings (column, kind, count) and never a value. All columns are scanned as text in one pass."""
    cols = as_list(columns) or df.columns
    long = unpivot_text(df, cols).where(strip_space(F.col("level")) != "")
    flags = cell_kinds(F.col("level"))
    counts = long.groupBy(F.col("variable").alias("column")).agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    rows = counts.select("column", F.inline(F.array(*[F.struct(F.lit(KINDS[k]).alias("kind"), F.col(k).alias("count")) for k in flags]))).where("count > 0")
    hinted = [c for c in cols if header_hint(c)]
    if not hinted:
        return rows
    s = strip_space(F.col("level"))
    word = ~F.lower(s).isin(*NEUTRAL_CODES) & ~s.rlike(I.CELL_CODE) & (F.length(F.regexp_replace(s, r"(?U)[^\p{L}]", "")) >= 3)
    texts = unpivot_text(df, hinted).where(strip_space(F.col("level")) != "").select(F.col("variable").alias("column"), s.alias("s")).where(word)
    # distinct texts first, with their counts: no distinct set is held per column
    per = texts.groupBy("column", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("different"), F.bool_or(F.col("s").contains(" ")).alias("spaced"))
    names = per.where("different > 3 or spaced").select("column", F.lit("names or identifiers (column name and content)").alias("kind"), "count")
    return rows.unionByName(names)


def without_noise(text: Column) -> Column:
    """The text without links and publication numbers. Every one of them holds a slash, a colon or the letters b and n in a row."""
    bn = reduce(lambda a, b: a | b, [text.contains(x) for x in ("bn", "bN", "Bn", "BN")])
    return F.when(text.contains("/") | text.contains(":") | bn, F.regexp_replace(text, I.TEXT_NOISE, " ")).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether the text holds anything but white space; null counts as empty."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


#: Names up to which the longest word of each is looked for in a text before the text is cut into words.
FEW_NAMES = 16


def name_counts(body: DataFrame, names: DataFrame) -> DataFrame:
    """``file, location, count`` of the units in ``body`` that hold listed names, in any case, between word boundaries.

    ``names`` (column ``name``) may be of any size: texts and names meet at the whole row of a name's words, and only
    such pairs are searched, so the time follows the words of the texts and what is found, not the number of names. Occurrences of one name do
    not overlap. Repeated names count once. Null names, names under three characters and names without a letter, digit
    or underscore find nothing. Equal texts are searched once.
    """
    fold = lambda w: F.replace(F.lower(F.upper(w)), F.lit("i\u0307"), F.lit("i"))
    words = lambda c: F.transform(F.array_remove(F.split(c, r"(?U)\W+"), ""), fold)
    listed = names.select(F.col("name").cast("string").alias("name")).where(F.length("name") >= 3).distinct()
    listed = listed.withColumn("words", words(F.col("name"))).where(F.size("words") > 0)
    # the hash of the words only brings pairs together; the pattern decides
    listed = materialize(listed.select("name", F.size("words").alias("n"), F.xxhash64(F.array_join("words", " ")).alias("row")), "listed")
    lengths = [r["n"] for r in listed.select("n").distinct().collect()]  # a short list: numbers of words of a name
    few = listed.select("name").limit(FEW_NAMES + 1)
    few = few.select(F.array_sort(words(F.col("name")), lambda a, b: F.length(b) - F.length(a))[0].alias("word")).collect()
    if 0 < len(few) <= FEW_NAMES:
        # a text with a name holds all its words; final and other sigma depend on what follows and count as one here
        one_sigma = lambda c: F.replace(c, F.lit("\u03c2"), F.lit("\u03c3"))
        folded = body.withColumn("_folded", one_sigma(fold(F.col("text"))))
        body = materialize(folded.where(reduce(lambda a, b: a | b, [F.contains("_folded", one_sigma(F.lit(r["word"]))) for r in few])).select("file", "location", "text"), "named_units")
    keyed = body.select("file", "location", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    rows = lambda n: F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, n), " ")))
    none = F.expr("cast(array() as array<bigint>)")
    held = keyed.select("key", words(without_noise(F.col("text"))).alias("words"))
    held = held.select("key", F.explode(F.array_distinct(F.concat(none, *[F.when(F.size("words") >= n, rows(n)).otherwise(none) for n in lengths]))).alias("row"))
    pairs = materialize(held.join(listed.select("name", "row"), "row").select("key", "name").distinct(), "listed_pairs")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    texts = keyed.select("key", "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    counts = texts.join(pairs, "key").select("key", F.regexp_count(without_noise(F.col("text")), pattern).alias("n")).groupBy("key").agg(F.sum("n").cast("long").alias("count"))
    return keyed.select("file", "location", "key").join(counts.where("count > 0"), "key").select("file", "location", "count")


def text_kinds(text: Column, names: Sequence[str] = (), allow_amounts: Sequence[str] = (), clean: Column | None = None, digit: Column | None = None) -> dict[str, Column]:
    """Number of occurrences of every kind of personal or confidential data in a text unit.

    ``clean`` (the text without noise) and ``digit`` (whether that holds a digit) are given where a table has them as columns.
    """
    clean = without_noise(text) if clean is None else clean
    digit = clean.rlike(r"(?U)\d") if digit is None else digit
    found = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    how_many = lambda t, p, ok: F.size(F.filter(found(t, p), ok))
    amounts = clean
    for p in allow_amounts:
        amounts = F.regexp_replace(amounts, f"(?iU){p}", " ")
    patterns = [rf"(?iU)(?<!\w){re.escape(n)}(?!\w)" for n in names if len(n) >= 3]
    listed = F.aggregate(F.transform(F.array(*map(F.lit, patterns)), lambda p: F.regexp_count(clean, p)), F.lit(0), lambda a, x: a + x) if patterns else F.lit(0)
    # exact pre-filters: without an @, a digit or a separator the pattern cannot match
    digits = lambda c: F.when(digit, c).otherwise(0)
    labels = clean.contains(":") | clean.contains("=") | (clean.contains("-") & clean.rlike(r"(?U)\s-\s"))
    return {
        "email": F.when(text.contains("@"), F.regexp_count(text, F.lit(I.CELL_EMAIL))).otherwise(0),
        "phone": digits(how_many(clean, I.TEXT_PHONE, lambda m: F.length(I.digits_only(m)).between(9, 15))),
        "iban": digits(how_many(F.upper(clean), I.IBAN, I.iban_ok)),
        "tckn": digits(how_many(clean, I.TEXT_ELEVEN, I.tckn_ok)),
        "hu_tax": digits(how_many(clean, I.TEXT_TEN, I.hu_tax_ok)),
        "card": digits(how_many(clean, I.TEXT_CARD, lambda m: I.luhn_ok(I.digits_only(m)))),
        "amount": digits(F.regexp_count(amounts, F.lit(I.TEXT_AMOUNT))),
        "invoice": digits(F.regexp_count(clean, F.lit(I.TEXT_INVOICE))),
        "listed": listed,
        "labelled": F.when(labels, F.regexp_count(clean, F.lit(I.TEXT_NAME_LABEL))).otherwise(0),
    }


def _wording_hits(rule: Mapping) -> Column:
    """One finding per occurrence of a wording rule."""
    flag = "(?iU)" if "i" in rule.get("flags", "i") else "(?U)"
    fixed = [F.lit("outdated wording").alias("check"), F.lit(rule["issue"]).alias("finding"), F.lit(1).cast("long").alias("count"),
             F.lit(rule.get("severity", "MEDIUM")).alias("severity"), F.lit(rule.get("current", "")).alias("action")]
    hits = F.regexp_extract_all("text", F.lit(flag + rule["pattern"]), F.lit(0))
    return F.transform(hits, lambda m: F.struct(*fixed, m.alias("matched")))


@analysis("text_audit", "Text audit", "Privacy")
def text_audit(units: DataFrame, rules: Sequence[Mapping] = (), names: Sequence[str] | DataFrame = (), allow_amounts: Sequence[str] = (), exempt_locations: Sequence[str] = ()) -> Result:
    """Personal data and outdated wording in text units ``(file, location, text)``.

    Personal findings carry kind and place only. A wording rule has ``pattern``, ``issue`` and
    optionally ``severity``, ``current`` and ``flags``; locations matching an exemption are not
    checked for wording. Listed names are a list or a table with a column ``name``. A file without any non-empty unit is unreadable, not clean.
    """
    # white space alone is no text; everything else is scanned whole
    body = units.where(has_text(F.col("text")))
    counts = text_kinds(F.col("text"), (), allow_amounts, F.col("_clean"), F.col("_digit"))
    severity = lambda k: "HIGH" if k in HIGH else "MEDIUM"
    entry = lambda k, c: F.struct(F.lit("personal or confidential data").alias("check"), F.lit(KINDS[k]).alias("finding"), c.cast("long").alias("count"), F.lit(severity(k)).alias("severity"),
                                  F.lit("remove or replace with a pseudonymised code").alias("action"), F.lit("").alias("matched"))
    # one scan for all patterns; the cleaned text is a column, so that it is made once and not for every kind
    packs = [F.array(*[entry(k, c) for k, c in counts.items() if k != "listed"])]
    if rules:
        exempt = reduce(lambda a, b: a | b, [F.col("location").rlike(f"(?iU){p}") for p in exempt_locations], F.lit(False))
        hits = F.concat(*[_wording_hits(r) for r in rules])
        packs.append(F.when(~exempt, hits).otherwise(F.slice(hits, 1, 0)) if exempt_locations else hits)
    scanned = body.select("file", "location", "text", without_noise(F.col("text")).alias("_clean")).withColumn("_digit", F.col("_clean").rlike(r"(?U)\d"))
    found = scanned.select("file", "location", F.inline(F.concat(*packs))).where("count > 0")
    given = names if isinstance(names, DataFrame) else units.sparkSession.createDataFrame([(n,) for n in names], "name string") if len(names) else None
    if given is not None:
        found = found.unionByName(name_counts(body, given).select("file", "location", F.inline(F.array(entry("listed", F.col("count"))))))
    per = found.groupBy("file").agg(
        F.sum(F.when(F.col("check") == "outdated wording", 0).otherwise(F.col("count"))).alias("personal"), F.sum(F.when(F.col("check") == "outdated wording", F.col("count")).otherwise(0)).alias("wording"))
    readable = units.groupBy("file").agg(F.count_if(has_text(F.col("text"))).alias("units"))
    s = readable.join(per, "file", "left").fillna(0, ["personal", "wording"])
    status = F.when(F.col("units") == 0, "unreadable").when(F.col("personal") > 0, "personal data").when(F.col("wording") > 0, "wording to update").otherwise("clean")
    return Result({"findings": found, "summary": s.withColumn("status", status)})


def split_units(df: DataFrame, file: str, text: str) -> DataFrame:
    """Lines of a text column as units ``(file, location, text)``."""
    return df.select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "text")).select(
        "file", F.concat(F.lit("line "), F.col("i") + 1).alias("location"), "text")


@analysis("claim_registry_audit", "Claim registry", "Audit")
def claim_registry_audit(documents: DataFrame, checks: Sequence[Mapping], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Expected and forbidden statements of every document; one row per document and check."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = []
    for c in checks:
        exp, required = str(c.get("expected", "")), bool(c.get("required", True))
        found = t.contains(exp) if exp else F.lit(False)
        hits = sum((t.contains(str(x)).cast("int") for x in c.get("forbidden", [])), F.lit(0))
        ok = (found | F.lit(not required)) & (hits == 0)
        rows.append(F.struct(F.lit(str(c.get("id", ""))).alias("id"), F.lit(required).alias("required"), found.alias("expected_found"), hits.alias("forbidden_hits"), F.when(ok, "PASS").otherwise("FAIL").alias("status")))
    return documents.select(key, F.inline(F.array(*rows)))


# ---------------------------------------------------------------- bibliographic references
def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters, from the Unicode decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_text(col: Column) -> Column:
    """Lower case without accents and punctuation, single spaces."""
    src, dst = _accents()
    flat = F.lower(F.translate(F.coalesce(col.cast("string"), F.lit("")), src, dst))
    return F.trim(F.regexp_replace(flat, "[^a-z0-9]+", " "))


def clean_doi(col: Column) -> Column:
    d = F.regexp_replace(F.trim(F.coalesce(col.cast("string"), F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.regexp_replace(F.trim(F.regexp_replace(d, r"(?i)^doi:\s*", "")), r"\.+$", "")


def similarity(a: Column, b: Column) -> Column:
    """Edit-distance ratio of two folded texts; zero if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(ratio(a, b, F.levenshtein(a, b)))


def first_surname(col: Column) -> Column:
    chunk = F.trim(F.element_at(F.split(F.coalesce(col, F.lit("")), r"[,;&]| and "), 1))
    parts = F.filter(F.split(chunk, r"\s+"), lambda p: (F.length(p) > 1) & ~p.endswith("."))
    return F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1))).otherwise(chunk)


@analysis("match_references", "Reference matching", "Audit")
def match_references(supplied: DataFrame, registry: DataFrame, strict: bool = False, floor: float = 0.85) -> DataFrame:
    """Supplied references against a registry table.

    Both tables: ref (supplied only), doi, title, year, authors, journal (registry: first_author);
    strict also compares volume, issue and pages. A DOI is joined exactly. Without a DOI the candidates
    are all registry titles whose edit-distance ratio is ``floor`` or more, whatever they differ in; equal titles are collapsed
    first, so a title that repeats a million times is one candidate. The best one by ratio (plus a bonus
    for the year) is kept by an aggregate. At the default, what is found is a match; a lower floor also
    gives the weak ones between it and 0.85.
    """
    s = supplied.withColumns({"_doi": clean_doi(F.col("doi")), "_t": fold_text(F.col("title")), "_year": F.substring(F.col("year").cast("string"), 1, 4)})
    extra = ["volume", "issue", "pages"] if strict else []
    fields = ["title", "year", "first_author", "journal", *extra]
    g = registry.withColumns({"_doi": clean_doi(F.col("doi")), "_rt": fold_text(F.col("title")), "year": F.col("year").cast("string")})
    found = F.struct(F.col("_doi").alias("found_doi"), *[F.col(f).alias(f"found_{f}") for f in fields])
    by_doi = g.where("_doi <> ''").groupBy("_doi").agg(F.min(found).alias("hit"))
    with_doi = s.where("_doi <> ''").join(by_doi, "_doi", "left").select(*s.columns, F.col("hit"), F.lit(True).alias("by_doi"))
    titles = g.where("_rt <> ''").groupBy(F.col("_rt").alias("b"), "year").agg(F.min(found).alias("hit"))
    asked = s.where("_doi = '' and _t <> ''").select(F.col("_t").alias("a"), "_year").distinct()
    pairs = materialize(similar_pairs(asked, titles, floor), "similar")
    score = F.col("ratio") + F.when(F.col("_year") == F.col("year"), 0.10).otherwise(0.0)
    best = asked.join(pairs, "a").join(titles, "b").groupBy("a", "_year").agg(F.max(F.struct(score.alias("score"), "hit")).alias("best"))
    no_doi = s.where("_doi = ''").join(best.select("a", F.col("_year").alias("_y"), F.col("best.hit").alias("hit")),
                                       (F.col("_t") == F.col("a")) & F.col("_year").eqNullSafe(F.col("_y")), "left").select(*s.columns, "hit", F.lit(False).alias("by_doi"))
    m = with_doi.unionByName(no_doi)
    given = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    title_sim = F.when(given("title"), similarity(F.col("_t"), fold_text(F.col("hit.found_title")))).otherwise(1.0)
    sn = first_surname(F.col("authors"))
    has = lambda c: F.coalesce(F.col(f"hit.found_{c}").cast("string"), F.lit("")) != ""
    issues = [
        F.when(given("title") & (title_sim < 0.80), "title"),
        F.when(given("year") & has("year") & (F.abs(F.col("_year").try_cast("int") - F.col("hit.found_year").try_cast("int")) > 1), "year"),
        F.when(given("authors") & has("first_author") & (sn != "") & (similarity(fold_text(sn), fold_text(F.col("hit.found_first_author"))) < 0.75), "first author"),
        F.when(given("journal") & has("journal") & (similarity(fold_text(F.col("journal")), fold_text(F.col("hit.found_journal"))) < 0.62), "journal")]
    issues += [F.when(given(f) & has(f) & (fold_text(F.col(f)) != fold_text(F.col(f"hit.found_{f}"))), f) for f in extra]
    m = m.withColumns({"title_similarity": F.when(F.col("hit").isNotNull(), title_sim), "disagreements": F.array_compact(F.array(*issues))})
    clean = F.size("disagreements") == 0
    status = (F.when(F.col("hit").isNull(), "NOT_FOUND").when(F.col("by_doi"), F.when(clean, "VERIFIED").otherwise("PARTIAL"))
              .when((F.col("title_similarity") >= 0.85) & ~F.array_contains("disagreements", "title"), "MATCH_FOUND").otherwise("WEAK_MATCH"))
    return m.select("ref", status.alias("status"), F.col("hit.found_doi").alias("found_doi"), F.col("hit.found_title").alias("found_title"), "title_similarity", F.array_join(F.when(F.col("hit").isNotNull(), F.col("disagreements")), "; ").alias("disagreements"))


# ---------------------------------------------------------------- safeguards
def k_anonymity(df: DataFrame, quasi_ids, k: int = 5) -> DataFrame:
    """Combinations of quasi-identifiers shared by fewer than k rows."""
    q = as_list(quasi_ids)
    return df.groupBy(*q).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


# Count columns that are suppressed.
COUNT_COLUMNS = ("episodes", "records", "documents", "entries", "count")


def suppress_small_cells(table: DataFrame, name: str, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Counts from 1 to k-1 replaced by ``<k`` in a result table, and a manifest of the suppressed cells."""
    cols = [c for c in table.columns if c in COUNT_COLUMNS and dict(table.dtypes)[c] not in ("string", "boolean")]
    first = table.columns[0]
    small = lambda c: F.col(c).between(1, k - 1)
    manifest = [table.where(small(c)).select(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(first).cast("string").alias("row")) for c in cols]
    out = table.withColumns({c: F.when(small(c), f"<{k}").otherwise(F.col(c).cast("string")) for c in cols}) if cols else table
    empty = small_table(table.sparkSession, [], "table string, column string, row string")
    return out, reduce(DataFrame.unionByName, manifest, empty)


def leaked_codes(tables: Mapping[str, DataFrame], codes: DataFrame, code: str = "episode") -> DataFrame:
    """Codes that occur as a whole token in any cell or column name of the given tables.

    A cell is cut into its tokens, runs of letters and digits. What a code has from its first to its last token
    can only stand where as many tokens of a cell stand in a row, so every such row of tokens is a key with the text
    in it, and the comparison is a join on equal texts, whatever token they begin with. Signs around a code are compared there.
    """
    token, sign = "[A-Za-z0-9]+", "[^A-Za-z0-9]"
    core = F.regexp_replace("code", f"^{sign}+|{sign}+$", "")
    known = codes.select(F.trim(F.col(code).cast("string")).alias("code")).where(F.length("code") >= 2).distinct()
    known = known.withColumn("core", core).where("core <> ''").withColumn("tokens", F.regexp_count("core", F.lit(token)))
    known = materialize(known, "codes")
    cells = [unpivot_text(t, t.columns).select(F.col("level").alias("cell")).where("level is not null") for t in tables.values()]
    spark = codes.sparkSession
    heads = small_table(spark, [(c,) for t in tables.values() for c in t.columns], "cell string")
    texts = reduce(DataFrame.unionByName, [*cells, heads]).distinct()
    lengths = [r["tokens"] for r in known.select("tokens").distinct().collect()]  # a short list: numbers of tokens of a code
    words, gaps = F.regexp_extract_all("cell", F.lit(token), F.lit(0)), F.split("cell", token)  # gap i stands before word i
    cut = texts.select(words.alias("words"), gaps.alias("gaps")).where(F.size("words") > 0).withColumn("tokens", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    cut = cut.where(F.size("words") >= F.col("tokens")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("tokens"))))
    inside = F.transform(F.sequence(F.lit(1), F.col("tokens")), lambda i: F.concat(F.when(i > 1, F.get("gaps", F.col("at") + i - 1)).otherwise(""), F.get("words", F.col("at") + i - 1)))
    found = cut.select(F.array_join(inside, "").alias("core"), F.get("gaps", F.col("at")).alias("left"), F.get("gaps", F.col("at") + F.col("tokens")).alias("right"), (F.col("at") > 0).alias("after"),
                       (F.col("at") + F.col("tokens") < F.size("words")).alias("before"))
    plain = known.where(F.col("code") == F.col("core")).join(found.select("core").distinct(), "core", "left_semi").select("code")
    odd = known.where(F.col("code") != F.col("core")).join(found.distinct(), "core")
    lead, trail = F.regexp_extract("code", f"^{sign}*", 0), F.regexp_extract("code", f"{sign}*$", 0)
    # no letter or digit may touch the code: signs that fill a whole gap would end at the next token
    free = lambda gap, mark, touched: (mark == "") | ~touched | (gap != mark)
    stands = F.col("left").endswith(lead) & F.col("right").startswith(trail) & free(F.col("left"), lead, F.col("after")) & free(F.col("right"), trail, F.col("before"))
    return plain.unionByName(odd.where(stands).select("code")).distinct()


def snapshot_hashes(df: DataFrame, key: str) -> DataFrame:
    """Key and hash of every row, to be stored with a locked table."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns) if c != key]
    return df.select(F.col(key).alias("key"), F.sha2(F.concat_ws("\u001f", *rest), 256).alias("hash"))


def snapshot_verify(df: DataFrame, key: str, manifest: DataFrame) -> DataFrame:
    """Rows changed, missing or added against a stored manifest of hashes."""
    now = snapshot_hashes(df, key)
    m = manifest.withColumnRenamed("hash", "old").join(now, "key", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "missing").when(F.col("old") != F.col("hash"), "changed")
    return m.select("key", state.alias("state")).where("state is not null")


def units_in_one_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Units of one table that the other lacks, compared without regard to case."""
    u = lambda d, first: d.select(F.lower(F.trim(F.col(key).cast("string"))).alias("unit"), F.lit(first).alias("a"), F.lit(not first).alias("b"))
    # one aggregation that can spill, and no join whose build side has to fit a task; a null unit has no counterpart
    both = u(a, True).unionByName(u(b, False)).groupBy("unit").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("unit is null or not a or not b")
    return both.select("unit", F.explode(F.array_compact(F.array(F.when(F.col("a"), F.lit("first")), F.when(F.col("b"), F.lit("second"))))).alias("only_in"))


def aligned_cells(a: DataFrame, b: DataFrame, key: str, columns) -> DataFrame:
    """Cells of two tables on their common units, side by side."""
    cols = as_list(columns)
    u = lambda d, name: unpivot_text(d.withColumn("unit", F.lower(F.trim(F.col(key).cast("string")))), cols, ["unit"]).select("unit", F.col("variable").alias("column"), F.col("level").alias(name))
    return u(a, "first").join(u(b, "second"), ["unit", "column"])


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of one value per key, with a changed flag."""
    m = a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full_outer")
    return m.withColumn("changed", ~F.col("first").eqNullSafe(F.col("second")))
