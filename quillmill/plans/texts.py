"""Text queries: scripts, guards, LaTeX repair, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources import tables as T

_CP = "CASE " + " ".join(f"WHEN cp BETWEEN {a} AND {b} THEN '{f}'" for f, a, b in X.SCRIPT_RANGES) + " END"
_CHARS = f"""chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents),
fam AS (SELECT doc_id, i, {_CP} AS family FROM (SELECT doc_id, i, unicode(ch) AS cp FROM chars))"""


def _families(spark, sf_dir):
    """doc_id, f (family, n, first) of each script family that a document has, without a shuffle or a row for each character."""
    return T.read(spark, sf_dir, "documents").select("doc_id", X.script_counts(F.col("text")).alias("f"))


@query(f"WITH {_CHARS} SELECT doc_id, family, count(*) AS n FROM fam WHERE family IS NOT NULL GROUP BY 1, 2")
def script_histogram(spark, sf_dir):
    rows = _families(spark, sf_dir).select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.family", "f.n")
    return rows.groupBy("doc_id", "family").agg(F.sum("n").alias("n"))


@query(f"WITH {_CHARS}, g AS (SELECT doc_id, family, count(*) AS n, min(i) AS f FROM fam WHERE family IS NOT NULL GROUP BY 1, 2) SELECT d.doc_id, coalesce(arg_max(family, n * 1000000 - f), 'latin') AS family FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY 1")
def dominant_script(spark, sf_dir):
    """The family with most characters, the first seen at a tie, latin without any."""
    best = F.array_max(F.transform("f", lambda x: F.struct(x["n"].alias("n"), (-x["first"]).alias("first"), x["family"].alias("family"))))["family"]
    return _families(spark, sf_dir).select("doc_id", F.coalesce(best, F.lit("latin")).alias("family"))


_MIX = [(-1, "ab бв"), (-2, "hello world"), (-3, "漢字かな"), (-4, "aaaaaaaaaaaaaaaaaaaaб"), (-5, "123 !?"), (-6, "αβγ abc")]
_MIX_SQL = ", ".join(f"({i}, '{t}')" for i, t in _MIX)


@query(
    f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {_MIX_SQL}) AS v(id, text)), c AS (SELECT id, unicode(unnest(string_split(text, ''))) AS cp FROM t),
    f AS (SELECT id, {_CP} AS family, count(*) AS n FROM c WHERE ({_CP}) IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT id, count(*) FILTER (n / t >= 0.08) AS strong FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM f) GROUP BY id)
    SELECT t.id, coalesce(strong, 0) >= 2 AS unsafe FROM t LEFT JOIN s USING (id)"""
)
def unsafe_script_mix(spark, sf_dir):
    """Whether two families or more have 8 % of the characters each: all documents, and literal rows of several scripts."""
    extra = spark.createDataFrame(_MIX, "id long, text string")
    rows = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(extra)
    rows = rows.select("id", X.script_counts(F.col("text")).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    rows = rows.select("id", "f", total.alias("total"))
    return rows.select("id", (F.size(F.filter("f", lambda x: x["n"] >= 0.08 * F.col("total"))) >= 2).alias("unsafe"))


_INJECTED = [(-1, "broken □ glyph"), (-2, "fine"), (-3, "lost � char"), (-4, "cfg.size and bbox::seed"), (-5, "render__seed962 acc.mean!="), (-6, "loss== data__prob=="), (-7, "data alone"), (-8, "100 % sure & well"), (-9, "x≤≥y"), (-10, "abc12de"), (-11, "   ")]
_INJECTED_SQL = ", ".join(f"({i}, 0, '{t}')" for i, t in _INJECTED)
_LINES = f"{T.DOC_LINES}, lines AS (SELECT doc_id, line, text FROM doc_lines UNION ALL SELECT * FROM (VALUES {_INJECTED_SQL}) AS v(doc_id, line, text))"


def _lines(spark, sf_dir):
    extra = spark.createDataFrame([(i, 0, t) for i, t in _INJECTED], "doc_id long, line long, text string")
    return T.doc_lines(spark, sf_dir).select("doc_id", "line", "text").unionByName(extra)


@query(f"WITH {_LINES} SELECT doc_id, line FROM lines WHERE regexp_matches(text, '[�□▯]')")
def tofu_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.has_tofu(F.col("text"))).select("doc_id", "line")


_OPS = X.CODE_OPERATORS
_TOKEN_SQL = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:(?:{X.CODE_WORDS}|seed|dpi)(?:[_:.]{{1,2}}[A-Za-z0-9]+)+(?:{_OPS})?|[A-Za-z]+(?:[_:.]{{1,2}}[A-Za-z0-9]+)+(?:{_OPS})|(?:{X.CODE_WORDS})(?:{_OPS}))"


@query(f"WITH {_LINES} SELECT doc_id, line, CAST(len(regexp_extract_all(text, '{_TOKEN_SQL}')) AS INTEGER) AS tokens FROM lines WHERE len(regexp_extract_all(text, '{_TOKEN_SQL}')) > 0")
def code_token_leak(spark, sf_dir):
    """Lines with debug-like tokens, of all documents and the literal rows."""
    rows = _lines(spark, sf_dir).withColumn("tokens", X.code_tokens(F.col("text")))
    return rows.where("tokens > 0").select("doc_id", "line", "tokens")


_NOISY = rf"""trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR regexp_matches(text, '[{X.SHAPES}]') OR regexp_matches(text, '[\p{{So}}\p{{Co}}\p{{Cc}}]')
 OR regexp_matches(text, '__|::|==|!=|\+=|-=|[<>{{}}\[\]|]|(?i:{X.NOISE_WORDS})') OR regexp_matches(text, '[A-Za-zÀ-ſ]{{2,}}[0-9]+[A-Za-zÀ-ſ0-9]+') OR regexp_matches(text, '[{X.MATH_SIGNS}]{{2,}}')
 OR regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])[A-Za-zÀ-ſА-Яа-я]+[0-9]+[A-Za-zÀ-ſА-Яа-я0-9]*(?:[^\p{{L}}\p{{N}}_]|$)')
 OR coalesce(length(regexp_replace(text, '[^{X.MATH_SIGNS}{{}}\[\]<>|%$#@&*~^]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0) > 0.03, false)"""


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS noisy FROM lines WHERE {_NOISY} GROUP BY 1")
def ocr_noise_guard(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.is_noisy(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("noisy"))


_LATEX = [(1, "sum_{i=1}^{n} i"), (2, " sqrt{x+1} "), (3, "\\frac{a}{b}"), (4, "x^2"), (5, ""), (6, "\\input{secret}"), (7, "a\nb"), (8, "alpha+beta"), (9, "\\Write18{ls}"), (10, "\\inputs ok"), (11, "\\begin { document }")]
_LATEX_SQL = ", ".join(f"({i}, '{t}')" for i, t in _LATEX)


@query(f"SELECT id, CASE WHEN regexp_matches(trim(text), '^({'|'.join(p.replace('{', chr(92) + '{') for p in X.LATEX_BEGINNINGS)})') THEN chr(92) || trim(text) ELSE trim(text) END AS expr FROM (VALUES {_LATEX_SQL}) AS v(id, text)")
def latex_normalize(spark, sf_dir):
    return spark.createDataFrame(_LATEX, "id int, text string").select("id", X.latex_normalise(F.col("text")).alias("expr"))


@query(
    rf"""SELECT id, CASE WHEN trim(text) = '' OR regexp_matches(text, '(?i)\\(?:{"|".join(X.LATEX_DENIED)})(?:[^A-Za-z0-9_]|$)') OR regexp_matches(text, '(?i)\\(?:begin|end)\s*\{{\s*document\s*\}}') THEN NULL
    ELSE replace(trim(text), chr(10), ' ') END AS expr FROM (VALUES {_LATEX_SQL}) AS v(id, text)"""
)
def latex_sanitize(spark, sf_dir):
    return spark.createDataFrame(_LATEX, "id int, text string").select("id", X.latex_sanitise(F.col("text")).alias("expr"))


@query("SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn)) AS page_text, count(*) AS lines FROM conversations GROUP BY conv_id")
def gt_page_text(spark, sf_dir):
    rows = T.conv_lines(spark, sf_dir).groupBy(F.col("page").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"), F.count("*").alias("lines"))
    return rows.select("conv_id", F.trim(F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("page_text"), "lines")


@query(f"WITH {T.DOC_LINES} SELECT doc_id, line, CASE WHEN text <> '' THEN text END AS text, CASE WHEN text <> '' THEN lang END AS script, length(text) AS n FROM doc_lines")
def gt_projection(spark, sf_dir):
    some = F.col("text") != ""
    return T.doc_lines(spark, sf_dir).select("doc_id", "line", F.when(some, F.col("text")).alias("text"), F.when(some, F.col("lang")).alias("script"), F.length("text").cast("long").alias("n"))


@query(f"WITH {T.DOC_LINES}, gt AS (SELECT doc_id, line, CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END AS gt FROM doc_lines) SELECT count(*) AS lines, count(gt) AS found, count(*) FILTER (contains(gt, text)) AS matched, round(count(*) FILTER (contains(gt, text)) / count(gt), 6) AS ratio FROM doc_lines LEFT JOIN gt USING (doc_id, line)")
def ann_gt_alignment(spark, sf_dir):
    """Annotation lines against ground truth derived from them: ids found, and texts that it contains."""
    ann = T.doc_lines(spark, sf_dir).select("doc_id", "line", "text")
    gt = ann.select("doc_id", "line", F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")).alias("gt"))
    hit = F.count_if(F.contains("gt", "text"))
    return ann.join(gt, ["doc_id", "line"], "left").agg(F.count("*").alias("lines"), F.count("gt").alias("found"), hit.alias("matched"), F.round(hit / F.count("gt"), 6).alias("ratio"))


@query("SELECT doc_id, len(list_distinct(list_filter(string_split(text, ''), lambda x: unicode(x) > 126 OR (unicode(x) < 32 AND unicode(x) <> 10)))) AS missing FROM documents")
def glyph_coverage(spark, sf_dir):
    """Distinct characters of each text that a font of printable ASCII lacks."""
    printable = F.array(*(F.lit(chr(c)) for c in [10, *range(32, 127)]))
    chars = F.array_except(F.array_distinct(F.split("text", "")), F.concat(printable, F.array(F.lit(""))))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.size(chars).cast("long").alias("missing"))


_NAMES = "SELECT s_suppkey, regexp_replace(trim(s_name || ' /é' || CAST(s_suppkey AS VARCHAR)), '[^A-Za-z0-9_.-]', '_', 'g') AS name, regexp_replace(s_name || 'é', '[^\\x00-\\x7F]', '?', 'g') AS ascii, right(s_name, 4) AS tail FROM supplier"


@query(_NAMES)
def name_cleanup(spark, sf_dir):
    rows = T.read(spark, sf_dir, "supplier")
    full = F.concat("s_name", F.lit(" /é"), F.col("s_suppkey").cast("string"))
    return rows.select("s_suppkey", X.safe_name(full).alias("name"), X.ascii_only(F.concat("s_name", F.lit("é"))).alias("ascii"), X.tail(F.col("s_name"), 4).alias("tail"))


@query(
    """WITH RECURSIVE w AS (SELECT p_partkey, string_split(trim(p_name), ' ') AS words, 60 + p_size * 3 AS width FROM part),
    f AS (SELECT p_partkey, max(CASE WHEN length(array_to_string(words[1:k], ' ')) * 10 <= width THEN k ELSE 0 END) AS k, any_value(words) AS words FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM w) GROUP BY 1)
    SELECT p_partkey, CASE WHEN length(array_to_string(words[1:k], ' ')) >= 4 THEN array_to_string(words[1:k], ' ') ELSE '' END AS fitted FROM f"""
)
def text_fit(spark, sf_dir):
    """Whole words of a name that fit a pixel width of ten a character."""
    return T.read(spark, sf_dir, "part").select("p_partkey", X.fit_words(F.col("p_name"), 60 + F.col("p_size") * 3).alias("fitted"))
