"""Words with boxes: visual rows, segments, label anchors and the values beside or below them, machine-readable pairs.

Words are rows (doc_id, page, ord, text, confidence, x, y, width, height). Every join has the document and
page as equal keys, so boxes are only compared within a page and distances stay residual predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.functions import identifiers, mrz, text

ROW_SHIFT, SEGMENT_GAP, SEGMENT_CHARS = 14.0, 60.0, 12
RIGHT_REACH, BELOW_REACH, LEFT_SLACK, RIGHT_SLACK = 200.0, 70.0, 12.0, 35.0
PAIR_GAP, PAIR_SHIFT = (12.0, 120.0), 80.0
REGION_FROM, REGION_CHARS, REGION_GAP = 0.45, 20, 0.18  # shares of the page's height, and characters
PAGE = ["doc_id", "page"]
# Labels of visa fields as word sequences, the more specific ones first.
VISA_LABELS = {
    "issuing_post_name": ["ISSUING POST NAME", "ISSUING POST"],
    "control_number": ["CONTROL NUMBER"],
    "passport_number": ["PASSPORT NUMBER", "PASSPORT NO", "PASSPORT NO."],
    "gender": ["SEX"],
    "date_of_birth": ["DATE OF BIRTH", "BIRTH DATE", "DOB"],
    "nationality": ["NATIONALITY"],
    "issue_date": ["ISSUE DATE", "DATE OF ISSUE"],
    "expiry_date": ["EXPIRATION DATE", "EXPIRY DATE", "DATE OF EXPIRY"],
    "entries": ["ENTRIES"],
    "visa_type": ["VISA TYPE", "TYPE"],
    "visa_class": ["CLASS", "VISA CLASS"],
    "annotation": ["ANNOTATION"],
    "visa_number": ["VISA NUMBER", "VISA NO", "VISA NO."],
    "holder_name": ["SURNAME GIVEN NAME", "HOLDER NAME"],
    "stay_duration": ["STAY DURATION", "DURATION OF STAY", "ADMIT UNTIL"],
}


def boxed(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Usable words: text that is not blank, numbers as such (confidence -1 if it is none), scaled back, with x2, y2 and cy."""
    n = lambda c: F.bround(F.col(c).try_cast("double") / scale)
    rows = words.withColumn("text", F.trim("text")).where(F.col("text") != "").withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), F.lit(-1.0)))
    rows = rows.withColumns({c: n(c) for c in ("x", "y", "width", "height")}).where((F.col("width") > 0) & (F.col("height") > 0))
    return rows.withColumns({"x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height"), "cy": F.col("y") + F.col("height") / 2})


def cluster_labels(centres: Column, shift: float = ROW_SHIFT) -> Column:
    """Row numbers of sorted centres: a row takes in what lies within the shift of its first word."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("labels"))

    def step(s: Column, c: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(c - s["anchor"]) > shift)
        k = F.when(new, s["k"] + 1).otherwise(s["k"])
        return F.struct(F.when(new, c).otherwise(s["anchor"]).alias("anchor"), k.alias("k"), F.concat(s["labels"], F.array(k)).alias("labels"))

    return F.aggregate(centres, start, step)["labels"]


def visual_rows(words: DataFrame) -> DataFrame:
    """The words with ``row``. A page's words are one array, as a row depends on the first word of the row before."""
    own = F.array_sort(F.collect_list(F.struct("cy", "x", *(c for c in words.columns if c not in (*PAGE, "cy", "x")))))
    pages = words.groupBy(*PAGE).agg(own.alias("w")).withColumn("label", cluster_labels(F.transform("w", lambda x: x["cy"].cast("double"))))
    return pages.select(*PAGE, F.explode(F.arrays_zip("w", "label")).alias("z")).select(*PAGE, "z.w.*", F.col("z.label").alias("row"))


def segments(rows: DataFrame, gap: float = SEGMENT_GAP, least: int = SEGMENT_CHARS) -> DataFrame:
    """Runs of words of one visual row without a wide gap, as text with a box; short ones are left out."""
    order = Window.partitionBy(*PAGE, "row").orderBy("x", "ord")
    opens = F.coalesce((F.col("x") - F.lag("x2").over(order) > gap).cast("int"), F.lit(1))
    parts = rows.withColumn("opens", opens).withColumn("segment", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy(*PAGE, "row", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda w: w["text"]), "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    return joined.where(F.length("text") >= least)


def label_anchors(rows: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """The box of each field's label: the first place, in reading order, of its first spelling that occurs.

    rows: words with ``row``. The words of a label follow one another in their row.
    """
    longest = max(len(s.split()) for own in labels.values() for s in own)
    order = Window.partitionBy(*PAGE, "row").orderBy("x", "ord")
    box = F.struct("x", "y", "x2", "y2")
    token = text.label_token(F.col("text"))
    here = rows.withColumn("token", token).withColumn("box", box)
    ahead = {k: (F.lead("token", k).over(order), F.lead("box", k).over(order)) for k in range(1, longest)}
    here = here.withColumn("tokens", F.array("token", *(t for t, _ in ahead.values()))).withColumn("boxes", F.array("box", *(b for _, b in ahead.values())))
    # only words that begin a label go on; the labels are a table of fixed size
    spellings = [(s.split()[0], f, n, s.split()) for f, own in labels.items() for n, s in enumerate(own)]
    table = rows.sparkSession.createDataFrame(spellings, "first string, field string, spelling int, words array<string>").select("first", F.struct("field", "spelling", "words").alias("label"))
    hits = here.join(F.broadcast(table), F.col("token") == F.col("first")).where(F.slice(F.col("tokens"), F.lit(1), F.size("label.words")) == F.col("label.words"))
    boxes = F.slice("boxes", 1, F.size("label.words"))
    edge = lambda f, pick: pick(F.transform(boxes, lambda b: b[f]))
    hits = hits.select(
        "doc_id",
        "label.field",
        "page",
        edge("x", F.array_min).alias("ax"),
        edge("x2", F.array_max).alias("ax2"),
        edge("y", F.array_min).alias("ay"),
        edge("y2", F.array_max).alias("ay2"),
        F.struct("label.spelling", "page", "y", "x", "ord").alias("rank"),
    )
    first = hits.groupBy("doc_id", "field").agg(F.min_by(F.struct("page", "ax", "ax2", "ay", "ay2"), "rank").alias("a"))
    return first.select("doc_id", "field", "a.*")


def _joined_by_x(words: Column) -> Column:
    return F.nullif(F.trim(F.array_join(F.transform(F.array_sort(words), lambda w: w["text"]), " ")), F.lit(""))


def label_texts(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, field, below (the text of the first visual row right under the label) and right (what stands right of it in its row).

    Every anchor has a row; a text that is not there is null. The words of the page are joined once for both.
    """
    page = words.select(*(F.col(c).alias(f"w_{c}") for c in PAGE), "cy", "x", "x2", "ord", "text")
    y, x = F.col("cy"), F.col("x")
    under = (y > F.col("ay2")) & (y <= F.col("ay2") + BELOW_REACH) & (F.col("x2") >= F.col("ax") - LEFT_SLACK) & (x <= F.col("ax2") + RIGHT_SLACK)
    beside = (F.abs(y - (F.col("ay") + F.col("ay2")) / 2) <= ROW_SHIFT) & (x > F.col("ax2")) & (x - F.col("ax2") <= RIGHT_REACH)
    same = (F.col("doc_id") == F.col("w_doc_id")) & (F.col("page") == F.col("w_page"))
    # Spark takes exploded words for as few bytes as what they come from and would broadcast them; the hint has them sorted instead
    near = anchors.join(page.hint("merge"), same & (under | beside), "left").withColumn("under", under)
    top = F.min(F.when(F.col("under"), y)).over(Window.partitionBy("doc_id", "field"))
    word = F.struct("x", "ord", "text")
    near = near.select("doc_id", "field", F.when(F.col("under") & (F.abs(y - top) <= ROW_SHIFT), word).alias("b"), F.when(beside, word).alias("r"))
    return near.groupBy("doc_id", "field").agg(_joined_by_x(F.collect_list("b")).alias("below"), _joined_by_x(F.collect_list("r")).alias("right"))


def labelled_values(rows: DataFrame, labels: dict[str, list[str]], parse, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, field and value: of what stands below a label, or if nothing does, right of it. parse: (field, text) to a column.

    texts: doc_id and text. With them a passport's cell that is no number by itself gives the only number of the text that ends as the
    cell does.
    """
    found = label_texts(label_anchors(rows, labels), rows).withColumn("cell", F.coalesce("below", "right"))
    value = parse(F.col("field"), F.col("cell"))
    if texts is None:
        return found.select("doc_id", "field", value.alias("value"))
    rows = found.join(texts.select("doc_id", F.col("text").alias("said")).hint("merge"), "doc_id", "left")
    whole = F.when(F.col("field") == "passport_number", identifiers.corroborated_passport(F.col("said"), F.col("cell")))
    return rows.select("doc_id", "field", F.coalesce(value, whole).alias("value"))


def machine_pairs(rows: DataFrame, visa: bool = False) -> DataFrame:
    """doc_id, line1, line2 and score of the best pair of rows that verifies: the second close under the first, starting near it.

    rows: doc_id, page, ord, text, x, y. Line 2 is corrected before it is checked; ties go to the earlier rows.
    """
    prefix = "V<" if visa else "P<"
    cleaned = rows.withColumn("line", mrz.clean_line(F.col("text"))).where(F.length("line") == mrz.LENGTH)
    # each row is corrected and checked once, before the join
    checks = [9, 19, 27] if visa else [9, 19, 27, 42]  # correction leaves check digits as they are
    numeric = F.concat(*(mrz.piece(F.col("line"), at, 1) for at in checks)).rlike(f"^[0-9]{{{len(checks)}}}$")
    # exploding the one corrected line keeps the filter on it from computing it again
    second = cleaned.where(numeric).withColumn("put", F.explode(F.array(mrz.corrected_line2(F.col("line"), visa)))).where("put.right").withColumn("line2", F.col("put.line")).select(*PAGE, F.col("ord").alias("ord2"), F.col("x").alias("bx"), F.col("y").alias("by"), "line2")
    starts = F.col("line").startswith(prefix) | (F.col("line").startswith("VN") if visa else F.lit(False))  # only these can be a line 1
    pairs = cleaned.where(starts).join(second.hint("merge"), PAGE).withColumn("gap", F.col("by") - F.col("y")).where(F.col("gap").between(*PAIR_GAP) & (F.abs(F.col("bx") - F.col("x")) <= PAIR_SHIFT))
    pairs = pairs.withColumn("line1", mrz.line1_of_row(F.col("text"), prefix, F.lit(True), F.col("gap"))).where(F.col("line1").isNotNull())
    score = 400.0 + mrz.line_score(F.col("line1"), prefix) + mrz.line_score(F.col("line2"), prefix) + F.greatest(F.lit(0.0), 80.0 - F.abs(F.col("x") - F.col("bx"))) + F.greatest(F.lit(0.0), 80.0 - F.col("gap"))
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "page", "ord", "ord2")
    return pairs.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where("rank = 1").select("doc_id", "line1", "line2", "score")


def pairs_of_documents(words: DataFrame, visa: bool = False, shift: float = ROW_SHIFT, gap: float = SEGMENT_GAP, least: int = SEGMENT_CHARS) -> DataFrame:
    """From boxed words to the best pair of machine-readable lines of each document, with a single exchange: doc_id, line1, line2, score
    and candidates (page, ord, text, role of every segment that is as long as a line).

    The same as ``machine_pairs`` of ``segments`` of ``visual_rows``, by array functions on a document's words; ``ord`` counts its
    segments. A document without a pair has null lines.
    """
    prefix = "V<" if visa else "P<"
    order = ["page", "cy", "x", "ord", "text", "x2", "y", "y2"]
    docs = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("cy").cast("double").alias("cy"), *order[2:]))).alias("w"))
    # a row takes in what lies within the shift of its first word
    start = F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, v: Column) -> Column:
        new = s["anchor"].isNull() | (s["page"] != v["page"]) | (F.abs(v["cy"] - s["anchor"]) > shift)
        k = F.when(new, s["k"] + 1).otherwise(s["k"])
        return F.struct(v["page"].cast("int").alias("page"), F.when(new, v["cy"]).otherwise(s["anchor"]).alias("anchor"), k.alias("k"), F.concat(s["rows"], F.array(k)).alias("rows"))

    docs = docs.withColumn("rows", F.aggregate("w", start, step)["rows"])
    placed = F.transform(F.arrays_zip("w", "rows"), lambda z: F.struct(z["rows"].alias("row"), *(z["w"][c].alias(c) for c in ("x", "ord", "page", "text", "x2", "y", "y2"))))
    docs = docs.select("doc_id", F.array_sort(placed).alias("w"))

    def opens(v: Column, i: Column) -> Column:
        before = F.get(F.col("w"), i - 1)
        return F.when(F.coalesce((before["row"] != v["row"]) | (v["x"] - before["x2"] > gap), F.lit(True)), i)

    docs = docs.withColumn("starts", F.array_compact(F.transform("w", opens)))

    def segment(begin: Column, n: Column) -> Column:
        part = F.slice(F.col("w"), begin + 1, F.coalesce(F.get(F.col("starts"), n + 1), F.size("w")) - begin)
        return mrz.once(part, lambda p: F.struct(F.get(p, F.lit(0))["page"].alias("page"), n.alias("ord"), F.array_join(F.transform(p, lambda v: v["text"]), "").alias("text"), F.array_min(F.transform(p, lambda v: v["x"])).alias("x"), F.array_min(F.transform(p, lambda v: v["y"])).alias("y")))

    docs = docs.select("doc_id", F.filter(F.transform("starts", segment), lambda s: F.length(s["text"]) >= least).alias("segments"))
    cleaned = F.transform("segments", lambda s: F.struct(*(s[c].alias(c) for c in ("page", "ord", "text", "x", "y")), mrz.clean_line(s["text"]).alias("line")))
    docs = docs.select("doc_id", F.filter(cleaned, lambda s: F.length(s["line"]) == mrz.LENGTH).alias("lines"))
    checks = [9, 19, 27] if visa else [9, 19, 27, 42]
    numeric = lambda x: F.concat(*(mrz.piece(x, at, 1) for at in checks)).rlike(f"^[0-9]{{{len(checks)}}}$")
    second = F.transform(F.filter("lines", lambda s: numeric(s["line"])), lambda s: F.struct(*(s[c].alias(c) for c in ("page", "ord", "x", "y")), mrz.corrected_line2(s["line"], visa).alias("put")))
    docs = docs.withColumn("second", second).withColumn("second", F.transform(F.filter("second", lambda s: s["put"]["right"]), lambda s: F.struct(*(s[c].alias(c) for c in ("page", "ord", "x", "y")), s["put"]["line"].alias("line2"))))
    starts_as = lambda line: line.startswith(prefix) | (line.startswith("VN") if visa else F.lit(False))

    def paired(a: Column) -> Column:
        near = F.filter("second", lambda b: (a["page"] == b["page"]) & (b["y"] - a["y"]).between(*PAIR_GAP) & (F.abs(b["x"] - a["x"]) <= PAIR_SHIFT))

        def scored(b: Column) -> Column:
            line1 = mrz.line1_of_row(a["text"], prefix, F.lit(True), b["y"] - a["y"])
            both = lambda one: 400.0 + mrz.line_score(one, prefix) + mrz.line_score(b["line2"], prefix) + F.greatest(F.lit(0.0), 80.0 - F.abs(a["x"] - b["x"])) + F.greatest(F.lit(0.0), 80.0 - (b["y"] - a["y"]))
            return mrz.once(line1, lambda one: F.when(one.isNotNull(), F.struct((-both(one)).alias("less"), a["page"].alias("page"), a["ord"].alias("ord"), b["ord"].alias("ord2"), one.alias("line1"), b["line2"].alias("line2"))))

        return F.transform(near, scored)

    pairs = F.array_compact(F.flatten(F.transform(F.filter("lines", lambda s: starts_as(s["line"])), paired)))
    roles = F.transform("lines", lambda s: F.struct(*(s[c].alias(c) for c in ("page", "ord", "text")), F.when(starts_as(s["line"]), "line1").when(F.exists("second", lambda b: b["ord"] == s["ord"]), "line2").otherwise("rejected").alias("role")))
    out = docs.select("doc_id", F.array_min(pairs).alias("best"), roles.alias("candidates"))
    return out.select("doc_id", "best.line1", "best.line2", (-F.col("best.less")).alias("score"), "candidates")


def candidate_checks(rows: DataFrame, visa: bool = False) -> DataFrame:
    """What was looked at when rows were taken or not taken for machine-readable lines: doc_id, page, ord, tier, role, line, nth, check,
    given, wanted and passed, a row for each check of each candidate.

    rows: doc_id, page, ord, text. A row is a candidate if it is as long as a line may be read, or begins as a first one does. A
    second line has two tiers: as read, and corrected where that gives another. A line of another length has only the check of its
    length. All checks of a tier come from one evaluation of its check digits.
    """
    prefix, correct = ("V<", mrz.correct_mrv) if visa else ("P<", mrz.correct_td3)
    digits = [("number", 0, 9), ("birth", 1, 19), ("expiry", 2, 27), *([] if visa else [("optional", 3, 42), ("composite", 4, 43)])]
    line, whole = F.col("line"), F.length("line") == mrz.LENGTH
    begins = line.startswith(prefix) | (line.startswith("VN") if visa else F.lit(False))
    found = rows.select(*PAGE, "ord", mrz.clean_line(F.col("text")).alias("line")).where(begins | F.length("line").between(38, 48))
    found = found.withColumn("role", F.when(begins, "line1").otherwise("line2"))
    better = F.when((F.col("role") == "line2") & whole, correct(line))
    tiers = F.array_compact(F.array(F.struct(F.lit("read").alias("tier"), line.alias("line")), F.when(F.col("better") != line, F.struct(F.lit("corrected").alias("tier"), F.col("better").alias("line")))))
    found = found.withColumn("better", better).select(*PAGE, "ord", "role", F.explode(tiers).alias("t")).select(*PAGE, "ord", "role", "t.*")
    check = lambda name, given, wanted, passed: F.struct(F.lit(name).alias("check"), given.alias("given"), wanted.alias("wanted"), F.coalesce(passed, F.lit(False)).alias("passed"))
    length = check("length", F.length("line").cast("string"), F.lit(str(mrz.LENGTH)), whole)
    first = F.array(length, check("prefix", F.substring(line, 1, 2), F.lit(prefix), line.startswith(prefix)), check("separator", F.regexp_extract(F.substring(line, 6, mrz.LENGTH), "<<", 0), F.lit("<<"), F.substring(line, 6, mrz.LENGTH).contains("<<")))
    wanted = mrz.check_digits(line)
    second = mrz.once(wanted, lambda w: F.array(length, *(check(f"{name} digit", mrz.piece(line, at, 1), F.get(w, F.lit(n)), mrz.piece(line, at, 1) == F.get(w, F.lit(n))) for name, n, at in digits)))
    checks = F.when(~whole, F.array(length)).when(F.col("role") == "line1", first).otherwise(second)
    return found.select(*PAGE, "ord", "tier", "role", "line", F.posexplode(checks).alias("nth", "c")).select(*PAGE, "ord", "tier", "role", "line", "nth", "c.*")


def rejections(checks: DataFrame) -> DataFrame:
    """doc_id, page, ord, role and why a candidate is none (its first failed check as read, with what was given and wanted), or null
    where one of its tiers passes all."""
    tiers = checks.groupBy(*PAGE, "ord", "role", "tier").agg(F.bool_and("passed").alias("passes"), F.min_by(F.struct("check", "given", "wanted"), F.when(~F.col("passed"), F.col("nth"))).alias("why"))
    own = tiers.groupBy(*PAGE, "ord", "role").agg(F.bool_or("passes").alias("passes"), F.max(F.when(F.col("tier") == "read", F.col("why"))).alias("why"))
    return own.select(*PAGE, "ord", "role", F.when(~F.col("passes"), F.col("why")).alias("why"))


def machine_region(rows: DataFrame) -> DataFrame:
    """doc_id, page, top and bottom of the part of a page where machine-readable lines are to be looked for.

    Of pairs of long rows in the lower half, one close under the other, the longest, best aligned and lowest counts; ties go to
    the earlier rows. A page without such a pair has its lower part. rows: doc_id, page, ord, text, x, y, y2, page_height.
    """
    low = rows.where((F.col("y") >= F.col("page_height") * REGION_FROM) & (F.length("text") >= REGION_CHARS))
    second = low.select(*PAGE, F.col("ord").alias("ord2"), F.length("text").alias("length2"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("y2").alias("by2"))
    gap = F.col("by") - F.col("y")
    pairs = low.join(second.hint("merge"), PAGE).where((F.col("ord2") > F.col("ord")) & gap.between(F.lit(PAIR_GAP[0]), F.greatest(F.lit(PAIR_GAP[1]), F.col("page_height") * REGION_GAP)))
    score = F.length("text") + F.col("length2") + F.greatest(F.lit(0.0), 100.0 - F.abs(F.col("x") - F.col("bx"))) + F.col("y") / F.col("page_height") * 10
    best = pairs.groupBy(*PAGE).agg(F.min_by(F.struct("y", "by2"), F.struct(-score, "ord", "ord2")).alias("best"))
    pages = rows.groupBy(*PAGE).agg(F.max("page_height").alias("h")).join(best.hint("merge"), PAGE, "left")
    top = F.coalesce(F.greatest(F.lit(0), F.col("best.y").cast("int") - 24), (F.col("h") * 0.55).cast("int"))
    bottom = F.coalesce(F.least(F.col("h").cast("int"), F.col("best.by2").cast("int") + 24), F.col("h").cast("int"))
    return pages.select(*PAGE, top.alias("top"), bottom.alias("bottom"))


def candidate_pairs(rows: DataFrame, prefix: str) -> DataFrame:
    """doc_id, line1, line2, ord1 and ord2 of each line 1 with the prefix and each line 2 of a passport or visa that verifies.

    rows: doc_id, ord and text; only texts of a line's length are looked at, and none is completed.
    """
    lines = rows.where(F.length("text") == mrz.LENGTH)
    first = lines.select("doc_id", F.col("ord").alias("ord1"), mrz.normalise_line1(F.col("text")).alias("line1")).where(F.col("line1").startswith(prefix) & (F.length("line1") == mrz.LENGTH))
    second = lines.where(mrz.valid_td3(F.col("text")) | mrz.valid_mrv(F.col("text"))).select("doc_id", F.col("ord").alias("ord2"), F.col("text").alias("line2"))
    return first.join(second.hint("merge"), "doc_id").select("doc_id", "line1", "line2", "ord1", "ord2")


def lowest_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k lowest rows of each page."""
    order = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), F.col("ord").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def word_metrics(words: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Mean confidence (1 decimal; of words that have one), words, and those below the threshold, per document."""
    known = F.col("confidence") >= 0
    return words.groupBy("doc_id").agg(F.bround(F.avg(F.when(known, F.col("confidence"))), 1).alias("confidence"), F.count("*").alias("tokens_detected"), F.count_if(known & (F.col("confidence") < threshold)).alias("tokens_requiring_review"))


def richest_reading(readings: DataFrame, keywords: list[str]) -> DataFrame:
    """The best reading of each page (most keywords, then most letters and digits, then the first), joined by page.

    readings: doc_id, page, variant, text.
    """
    hits = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.upper("text").contains(k)))
    rank = F.struct(hits.alias("k"), F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", "")).alias("n"), (-F.col("variant")).alias("v"))
    pages = readings.groupBy("doc_id", "page").agg(F.max_by("text", rank).alias("text")).where(F.trim("text") != "")
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
