"""Queries over documents, pages and rendered titles: text functions and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import classify_drives as dr
from pricelens.operators import classify_pc as pc
from pricelens.operators.classify_keywords import classify_keywords, first_match
from pricelens.operators.profiles import Profile, classify_by_watch, register
from pricelens.plans import frames as fr
from pricelens.plans.registry import query
from pricelens.plans.title_cases import DRIVE_CASES, KW_CASES, KW_CFG, PC_CASES, PC_CFG

# ---------------------------------------------------------------- documents and pages

NORM_SQL = r"""lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(strip_accents({0}), '’', ''''), '“', '"'), '”', '"'),
 '''''', '"'), '—', '-'), '–', '-'), '\s+', ' ', 'g')))"""


@query("text_normalize", f"SELECT doc_id, {NORM_SQL.format('text')} AS norm FROM documents")
def text_normalize(spark, sf):
    return fr.big(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))


# Words that occur in the invented prose, in place of the marketplace vocabulary.
DOC_KEYWORDS = {"dead": ["token =", "of the", "nas"], "external": ["und", "der die"], "bundle": ["no la", "las", "est"], "smr": ["the", "+1"]}


def _kw_sql(words: list[str]) -> str:
    parts = []
    for w in words:
        body = "".join("\\" + c if c in ".+" else c for c in w)
        parts.append(("(^|[^a-z0-9])" if w[0].isalnum() else "") + body + ("([^a-z0-9]|$)" if w[-1].isalnum() else ""))
    return "|".join(f"({p})" for p in parts)


@query("keyword_flags", "SELECT doc_id, " + ", ".join(f"regexp_matches(n, '{_kw_sql(w)}') AS {c}" for c, w in DOC_KEYWORDS.items())
       + f" FROM (SELECT doc_id, {NORM_SQL.format('text')} AS n FROM documents)")
def keyword_flags(spark, sf):
    norm = fr.big(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("n"))
    return norm.select("doc_id", *[tx.has_keyword(F.col("n"), words).alias(name) for name, words in DOC_KEYWORDS.items()])


NEGATED_WORDS = ["the", "la", "of", "en", "der", "ouch"]


@query("keyword_negation", f"""
  SELECT doc_id, regexp_matches(n, '(^|[^a-z0-9])(the|la|of|en|der|ouch)([^a-z0-9]|$)') AS quoted,
    regexp_matches(regexp_replace(n, '(aucune?|sans|pas de|zero|no|ohne|keine|non|0) (the|la|of|en|der|ouch)([^a-z0-9]|$)', '\\1 \\3', 'g'),
      '(^|[^a-z0-9])(the|la|of|en|der|ouch)([^a-z0-9]|$)') AS affirmed
  FROM (SELECT doc_id, {NORM_SQL.format('line')} AS n FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS line FROM documents))""")
def keyword_negation(spark, sf):
    lines = fr.big(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\. ", -1)).alias("line"))
    norm = lines.select("doc_id", tx.normalize_text(F.col("line")).alias("n"))
    return norm.select("doc_id", tx.has_keyword(F.col("n"), NEGATED_WORDS).alias("quoted"),
                       tx.find_affirmed_keyword(F.col("n"), NEGATED_WORDS).isNotNull().alias("affirmed"))


_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
             ("&eacute;", "é"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&mdash;", "—"), ("&amp;", "&")]
_html = r"regexp_replace(regexp_replace(html, '(?i)<(br|/p|/div|/li|/tr)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in _ENTITIES:
    _html = f"replace({_html}, '{_e}', '{_c}')"


@query("html_to_text", f"SELECT page_id, trim(regexp_replace({_html}, '[ \\t]+', ' ', 'g'), E' \\n\\t\\r') AS body FROM pages")
def html_to_text(spark, sf):
    return fr.big(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


# ---------------------------------------------------------------- rendered titles

def rendered(spark, sf, cases):
    """Line items with the title and description of their case; ``{q}`` becomes the quantity."""
    line = fr.big(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    slot = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(cases) + 1).cast("int")
    pick = {name: F.element_at(F.array(*[F.lit(c[i]) for c in cases]), slot) for i, name in enumerate(("title", "description"))}
    filled = {n: F.replace(c, F.lit("{q}"), F.col("q").cast("string")) for n, c in pick.items()}
    return line.select("*", (slot - 1).alias("slot"), filled["title"].alias("title"), filled["description"].alias("description"),
                       F.lit("used").alias("condition_code"))


ROW = ["l_orderkey", "l_linenumber", "l_partkey"]
LINE_SQL = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, " \
           "(l_orderkey * 7 + l_linenumber) % {n} AS slot FROM lineitem"


def _expected(cases, columns) -> str:
    """SELECT stating the expected value of every case."""
    cols = []
    for i, (name, kind) in enumerate(columns):
        if kind == "raw":
            body = " ".join(f"WHEN {k} THEN '{c[i + 2]}'" for k, c in enumerate(cases))
            cols.append(f"CASE slot {body} END AS {name}")
        else:
            body = " ".join(f"WHEN {k} THEN {c[i + 2]}" for k, c in enumerate(cases))
            cols.append(f"CAST(CASE slot {body} END AS {kind}) AS {name}")
    return f"SELECT {', '.join(ROW)}, {', '.join(cols)} FROM ({LINE_SQL.format(n=len(cases))})"


_COMMON = [("verdict", "raw"), ("reason", "VARCHAR"), ("family", "VARCHAR"), ("model", "VARCHAR"), ("flags", "VARCHAR"), ("quantity", "BIGINT")]
DRIVE_CFG = {"target_capacity_tb": 8, "models": fv.DRIVE_CATALOGUE}


def _result(df, *attrs):
    return df.select(*ROW, "verdict", "reason", "family", "model", fr.joined(F.col("flags")).alias("flags"), "quantity",
                     *[F.try_element_at("attrs", F.lit(a)).cast("bigint").alias(a) for a in attrs])


@query("classify_drives", _expected(DRIVE_CASES, _COMMON + [("smart_hours", "BIGINT")]))
def classify_drives(spark, sf):
    return _result(dr.classify_drives(rendered(spark, sf, DRIVE_CASES), DRIVE_CFG), "smart_hours")


@query("classify_pc", _expected(PC_CASES, _COMMON + [("ram_gb", "BIGINT"), ("storage_gb", "BIGINT")]))
def classify_pc(spark, sf):
    return _result(pc.classify_pc(rendered(spark, sf, PC_CASES), PC_CFG), "ram_gb", "storage_gb")


@query("classify_keywords", _expected(KW_CASES, _COMMON))
def run_classify_keywords(spark, sf):
    return _result(classify_keywords(rendered(spark, sf, KW_CASES), KW_CFG))


# The keyword profile over whole documents, with a dictionary taken from their prose.
DOC_CFG = {"require_any": ["the", "la", "der"], "reject": ["token"], "families": [
    {"name": "fr", "any": ["une", "les"]}, {"name": "de", "any": ["und", "nicht"]}, {"name": "es", "any": ["las", "una"]}],
    "require_family": True}


@query("classify_keywords_documents", f"""
  SELECT doc_id, CASE WHEN regexp_matches(n, '{_kw_sql(['token'])}') THEN 'reject:token' WHEN NOT regexp_matches(n, '{_kw_sql(['the', 'la', 'der'])}') THEN 'no_match'
    WHEN fam IS NULL THEN 'family_unknown' END AS reason,
    CASE WHEN NOT regexp_matches(n, '{_kw_sql(['token'])}') AND regexp_matches(n, '{_kw_sql(['the', 'la', 'der'])}') THEN fam END AS family
  FROM (SELECT doc_id, n, CASE WHEN regexp_matches(n, '{_kw_sql(['une', 'les'])}') THEN 'fr' WHEN regexp_matches(n, '{_kw_sql(['und', 'nicht'])}') THEN 'de'
    WHEN regexp_matches(n, '{_kw_sql(['las', 'una'])}') THEN 'es' END AS fam FROM (SELECT doc_id, {NORM_SQL.format('text')} AS n FROM documents))""")
def classify_keywords_documents(spark, sf):
    docs = fr.big(spark, sf, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("description"),
                                                   F.lit("used").alias("condition_code"))
    return classify_keywords(docs, DOC_CFG).select("doc_id", "reason", "family")


# Watches over the documents, their words by a rule over their numbers.
WATCH_WORDS = [["the", "of"], ["la", "las"], ["der", "und"], ["les", "une"], ["token", "en"], ["est", "no la"]]
N_WATCHES = 24


def _watch_words(i, step):
    return WATCH_WORDS[(i + step) % len(WATCH_WORDS)]


def _word_watch(i):
    cfg = {"require_any": _watch_words(i, 0) + _watch_words(i, 1), "reject": _watch_words(i, 2)[:1] if i % 3 == 0 else [],
           "families": [{"name": f"f{k}", "any": _watch_words(i, k)} for k in range(i % 4)], "require_family": (False, "flag", True)[i % 3]}
    return {"watch": f"w{i}", "profile": {"type": "keywords", "keywords": cfg}}


def _words_table() -> str:
    """VALUES rows of (watch, required, rejected, families in order, mode), patterns null where a watch has none."""
    rows = []
    for i in range(N_WATCHES):
        cfg = _word_watch(i)["profile"]["keywords"]
        families = [f"'{_kw_sql(f['any'])}'" for f in cfg["families"]] + ["CAST(NULL AS VARCHAR)"] * (3 - len(cfg["families"]))
        rejected = f"'{_kw_sql(cfg['reject'])}'" if cfg["reject"] else "CAST(NULL AS VARCHAR)"
        rows.append(f"({i}, '{_kw_sql(cfg['require_any'])}', {rejected}, '{(cfg['reject'] or [''])[0]}', {', '.join(families)}, '{cfg['require_family']}')")
    return ", ".join(rows)


@query("classify_keyword_watches", f"""
  WITH s(watch, required, rejected, word, f0, f1, f2, mode) AS (VALUES {_words_table()}),
  m AS (SELECT doc_id, s.*, coalesce(regexp_matches(n, rejected), FALSE) AS bad, regexp_matches(n, required) AS has,
      CASE WHEN regexp_matches(n, f0) THEN 'f0' WHEN regexp_matches(n, f1) THEN 'f1' WHEN regexp_matches(n, f2) THEN 'f2' END AS fam
    FROM (SELECT doc_id, {NORM_SQL.format('text')} AS n FROM documents) JOIN s ON s.watch = doc_id % {N_WATCHES})
  SELECT doc_id, 'w' || watch AS watch, CASE WHEN bad THEN 'reject:' || word WHEN NOT has THEN 'no_match' WHEN mode = 'True' AND fam IS NULL THEN 'family_unknown' END AS reason,
    CASE WHEN NOT bad AND has THEN fam END AS family,
    CASE WHEN bad OR NOT has OR fam IS NOT NULL OR mode = 'True' THEN '' WHEN mode = 'flag' THEN 'family_unknown|model_unknown' ELSE 'model_unknown' END AS flags FROM m""")
def classify_keyword_watches(spark, sf):
    """Twenty-four watches with different words over whole documents, in one pass."""
    docs = fr.big(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("w"), F.col("doc_id") % N_WATCHES).alias("watch"), F.lit("").alias("title"), F.col("text").alias("description"), F.lit("used").alias("condition_code"))
    out = classify_by_watch(docs, {f"w{i}": _word_watch(i) for i in range(N_WATCHES)})
    return out.select("doc_id", "watch", "reason", "family", fr.joined(F.col("flags")).alias("flags"))


MIXED = {"hdd": {"watch": "hdd", "profile": {"type": "hdd", "hdd": DRIVE_CFG}}, "pc": {"watch": "pc", "profile": {"type": "pc", "pc": PC_CFG}},
         "card": {"watch": "card", "profile": {"type": "keywords", "keywords": KW_CFG}}}
ALL_CASES = [c[:8] for c in DRIVE_CASES] + [c[:8] for c in PC_CASES] + [c[:8] for c in KW_CASES]
_SPLIT = f"CASE WHEN slot < {len(DRIVE_CASES)} THEN 'hdd' WHEN slot < {len(DRIVE_CASES) + len(PC_CASES)} THEN 'pc' ELSE 'card' END"


def _mixed(spark, sf):
    df = rendered(spark, sf, ALL_CASES)
    own = F.when(F.col("slot") < len(DRIVE_CASES), "hdd").when(F.col("slot") < len(DRIVE_CASES) + len(PC_CASES), "pc").otherwise("card")
    return df.withColumn("watch", own)


@query("classify_by_watch", f"SELECT {_SPLIT} AS watch, verdict, reason, quantity, count(*) AS n FROM ("
       + _expected(ALL_CASES, _COMMON).replace("SELECT ", "SELECT slot, ", 1) + ") GROUP BY ALL")
def run_classify_by_watch(spark, sf):
    out = classify_by_watch(_mixed(spark, sf), MIXED)
    return out.groupBy("watch", "verdict", "reason", "quantity").agg(F.count("*").alias("n"))


def _short_title(df, cfg):
    return classify_keywords(df, cfg).withColumn("verdict", F.when(F.length("title") < cfg["min_length"], "reject").otherwise(F.col("verdict")))


@query("profile_registry", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN length('3080 n°' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) < 9 "
       "THEN 'reject' ELSE 'accept' END AS verdict FROM lineitem")
def profile_registry(spark, sf):
    register(Profile("short_title", _short_title))
    watch = {"w": {"watch": "w", "profile": {"type": "short_title", "short_title": {**KW_CFG, "min_length": 9}}}}
    rows = rendered(spark, sf, [("3080 n°{q}", "")]).withColumn("watch", F.lit("w"))
    return classify_by_watch(rows, watch).select(*ROW, "verdict")


# ---------------------------------------------------------------- parts of the classifiers

_ST = ["VN", "NM", "DM", "VX", "ZZ"], ["004", "0055", "004", "004", "123"]
_WD = ["80", "101", "8003", "40"], ["EFZZ", "PURZ", "EDAZ"]


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def references(spark, sf):
    """Titles with one Seagate and one WD reference written from the line item's numbers."""
    df = fr.big(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey")
    k, o = F.col("l_partkey"), F.col("l_orderkey")
    sep = _pick(["", " ", "-"], o)
    cap = (F.lit(4000) + k % 4 * 2000).cast("string")
    seagate = F.concat(F.lit("ST"), sep, cap, sep, _pick(_ST[0], o), sep, _pick(_ST[1], o))
    wd = F.concat(F.lit("Wd"), sep, _pick(_WD[0], o + k), sep, _pick(_WD[1], k))
    upper = F.upper(tx.strip_marks(F.concat(F.lit("Modèle "), seagate, F.lit(" / "), wd, F.lit(" ou "), seagate)))
    return df.withColumn("upper", upper).withColumn("hits", dr.reference_hits(F.col("upper"), dr.Catalogue(fv.DRIVE_CATALOGUE)))


def _arr(values, number):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(({number}) % {len(values)} AS INTEGER) + 1]"


REFS_SQL = f"""SELECT *, 'ST' || scap || cls || {_arr(_ST[1], 'l_orderkey')} AS sref, 'WD' || dig || suf AS wref,
    CASE dig WHEN '80' THEN 8000 WHEN '101' THEN 10000 WHEN '8003' THEN 8000 ELSE 4000 END AS wcap FROM (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, 4000 + l_partkey % 4 * 2000 AS scap, {_arr(_ST[0], 'l_orderkey')} AS cls,
    {_arr(_WD[0], 'l_orderkey + l_partkey')} AS dig, {_arr(_WD[1], 'l_partkey')} AS suf FROM lineitem)"""


@query("reference_extract", f"SELECT l_orderkey, l_linenumber, l_partkey, sref || '|' || wref AS refs FROM ({REFS_SQL})")
def reference_extract(spark, sf):
    return references(spark, sf).select(*ROW, F.array_join(F.transform("hits", lambda h: h["ref"]), "|").alias("refs"))


@query("reference_capacity", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(scap AS BIGINT) AS cap_1, CAST(wcap AS BIGINT) AS cap_2 FROM ({REFS_SQL})")
def reference_capacity(spark, sf):
    return references(spark, sf).select(*ROW, F.get("hits", F.lit(0))["cap"].alias("cap_1"), F.get("hits", F.lit(1))["cap"].alias("cap_2"))


_S_FAM = "CASE cls WHEN 'VN' THEN 'IronWolf' WHEN 'NM' THEN 'Exos' WHEN 'DM' THEN 'Barracuda' WHEN 'VX' THEN 'SkyHawk' END"
_S_WHY = ("CASE cls WHEN 'VN' THEN CASE WHEN scap = 8000 THEN NULL ELSE 'ref_unverified' END WHEN 'NM' THEN CASE WHEN scap = 8000 THEN NULL "
          "ELSE 'ref_unverified' END WHEN 'DM' THEN 'smr' WHEN 'VX' THEN 'low_tier' ELSE 'ref_unverified' END")
_W_FAM = "CASE suf WHEN 'EFZZ' THEN 'WD Red Plus' WHEN 'PURZ' THEN 'WD Purple' ELSE 'WD Blue/Elements' END"
_W_WHY = "CASE suf WHEN 'EFZZ' THEN CASE WHEN dig = '80' THEN NULL ELSE 'ref_unverified' END WHEN 'PURZ' THEN 'low_tier' ELSE 'smr' END"


@query("catalogue_match", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, sref AS ref, {_S_FAM} AS family, CASE WHEN cls = 'DM' THEN 'reject' ELSE 'accept' END AS verdict, {_S_WHY} AS reason FROM ({REFS_SQL})
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, wref, CASE WHEN wref = 'WD80EDAZ' THEN {_W_FAM} ELSE {_W_FAM} END,
    CASE WHEN suf = 'EDAZ' THEN 'reject' ELSE 'accept' END, {_W_WHY} FROM ({REFS_SQL})""")
def catalogue_match(spark, sf):
    return references(spark, sf).select(*ROW, F.inline("hits")).select(*ROW, "ref", "family", "verdict", "reason")


@query("best_reference", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN sok AND (NOT wok OR srank <= wrank) THEN sref WHEN wok THEN wref END AS best FROM (
    SELECT *, scap = 8000 AND cls <> 'DM' AS sok, wcap = 8000 AND suf <> 'EDAZ' AS wok,
      CASE WHEN {_S_WHY} IS NULL THEN 0 WHEN {_S_WHY} = 'low_tier' THEN 2 ELSE 1 END AS srank,
      CASE WHEN {_W_WHY} IS NULL THEN 0 WHEN {_W_WHY} = 'low_tier' THEN 2 ELSE 1 END AS wrank FROM ({REFS_SQL}))""")
def best_reference(spark, sf):
    good = F.filter("hits", lambda h: (h["verdict"] == "accept") & (h["cap"] == 8000))
    return references(spark, sf).select(*ROW, dr.best_reference(good)["ref"].alias("best"))


def numbers(spark, sf):
    return fr.big(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", F.col("l_quantity").cast("bigint").alias("q"),
        (F.col("l_partkey") % 12 + 1).alias("n"))


NUM_SQL = ("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_partkey % 12 + 1 AS n FROM lineitem")


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("capacity_set", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(list_filter(
    CASE l_linenumber % 3 WHEN 0 THEN [n * 1000, q * 40] WHEN 1 THEN CASE WHEN n = q THEN [n * 1000] ELSE [n * 1000] END
      ELSE CASE WHEN n = q THEN [n * 1000] ELSE CASE WHEN q <= 50 THEN [n * 1000] END END END, lambda c: c BETWEEN 100 AND 30000))), '|') AS caps FROM ({NUM_SQL})""")
def capacity_set(spark, sf):
    """Capacities in TB and GB; a lot total counts only when it is quoted more than once."""
    df = numbers(spark, sf)
    n, q = F.col("n"), F.col("q")
    title = F.when(F.col("l_linenumber") % 3 == 0, _say("disque ", n, " to, cache ", q * 40, " go")).when(
        F.col("l_linenumber") % 3 == 1, _say(q, " disques de ", n, " to")).otherwise(
        F.when(n == q, _say("disque ", n, " to et ", n, " tb, total ", n, " to")).otherwise(_say("disque ", n, " to, total ", q, " to")))
    caps = F.transform(F.sort_array(dr.capacity_set(title)), lambda c: c.cast("string"))
    return df.select(*ROW, F.array_join(caps, "|").alias("caps"))


@query("capacity_consistency", f"""
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE k WHEN 0 THEN CASE WHEN n <> 8 THEN 'capacity_mismatch' END WHEN 2 THEN 'no_capacity' WHEN 3 THEN CASE WHEN n <> 8 AND n <> 9 THEN 'generic' END
      WHEN 4 THEN CASE WHEN q > 1 AND n <> 8 THEN 'capacity_mismatch' WHEN n <> 8 THEN 'capacity_mismatch' END
      WHEN 5 THEN CASE WHEN q > 1 AND n <> 8 AND n * q = 8 THEN 'capacity_mismatch' END END AS reason,
    CASE k WHEN 0 THEN n <> 8 WHEN 1 THEN n <> 8 WHEN 3 THEN n = 8 OR n = 9 WHEN 4 THEN n <> 8
      WHEN 5 THEN n <> 8 AND NOT (q > 1 AND n = 8 * q) WHEN 6 THEN n <> 8 ELSE FALSE END AS competing FROM (SELECT *, (l_orderkey + l_linenumber) % 7 AS k FROM ({NUM_SQL}))""")
def capacity_consistency(spark, sf):
    """One capacity, two, none, a list; the total of a lot; a lot of small ones; a chosen reference that brings a capacity."""
    df = numbers(spark, sf).withColumn("k", (F.col("l_orderkey") + F.col("l_linenumber")) % 7)
    n, q, kind = F.col("n"), F.col("q").cast("bigint"), F.col("k")
    title = F.when(kind == 2, F.lit("disque dur")).when(kind == 3, _say("disque ", n, " to, 8 to, 9 to")).when(
        kind.isin(1, 5), _say("disque ", n, " to ou 8 to")).otherwise(_say("disque ", n, " to"))
    df = df.withColumns({"caps": F.when(kind == 6, F.array(F.lit(8000).cast("bigint"))).otherwise(dr.capacity_set(title)), "title": title})
    reason, several = dr.capacity_reason(
        F.col("caps"), kind == 4, F.when(kind.isin(4, 5), q).otherwise(F.lit(1).cast("bigint")), kind == 6,
        F.when(kind == 6, n.cast("bigint") * 1000).otherwise(F.lit(0).cast("bigint")), 8000, F.lit("disque"))
    return df.select(*ROW, reason.alias("reason"), several.alias("competing"))


@query("lot_quantity", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN q BETWEEN 2 AND 20 THEN q WHEN n >= 2 THEN n ELSE 1 END
      WHEN 1 THEN CASE WHEN q BETWEEN 2 AND 20 THEN q ELSE 1 END ELSE 1 END AS drives,
    CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN q BETWEEN 2 AND 50 THEN q ELSE 1 END WHEN 1 THEN 1
      ELSE CASE WHEN q BETWEEN 2 AND 50 THEN q ELSE 1 END END AS pcs FROM ({NUM_SQL})""")
def lot_quantity(spark, sf):
    df = numbers(spark, sf)
    kind = F.col("l_linenumber") % 3
    title = F.when(kind == 0, _say("lot de ", F.col("q"), " ou ", F.col("n"), " disques")).when(
        kind == 1, _say(F.col("q"), "x 8to")).otherwise(_say("optiplex x", F.col("q"), " neufs"))
    return df.select(*ROW, dr.drive_lot_quantity(title).alias("drives"), pc.pc_lot_quantity(title).alias("pcs"))


@query("usage_hours", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN q * 1000 + 250 WHEN 1 THEN greatest(q * 100, n * 1000)
    ELSE CASE WHEN q >= 1 THEN q * 1100 END END AS hours FROM ({NUM_SQL})""")
def usage_hours(spark, sf):
    df = numbers(spark, sf)
    kind = F.col("l_linenumber") % 3
    title = F.when(kind == 0, _say("disque ", F.col("q"), " 250 heures")).when(
        kind == 1, _say(F.col("q"), "00 h puis ", F.col("n"), ".000 hours, 99 h, 900000 h")).otherwise(
        _say("power-on hours: ", F.col("q") * 1100))
    return df.select(*ROW, dr.usage_hours(title).alias("hours"))


_HINTS = ["iron wolf 8to", "exos 8to", "western digital 8to red", "wd red plus", "hitachi 8to", "toshiba 8to", "skyhawk", "inconnu"]
_HINT_SQL = (["IronWolf", "Exos", "WD Red", "WD Red Plus", "Ultrastar", None, "SkyHawk", None],
             ["Seagate", "Seagate", "WD", "WD", "WD/HGST", "Toshiba", "Seagate", None])


@query("family_hint", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, " + ", ".join(
    f"CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals) if v) + f" END AS {name}"
    for name, vals in zip(("family", "brand"), _HINT_SQL)) + ", l_partkey % 8 = 6 AS low FROM lineitem")
def family_hint(spark, sf):
    df = numbers(spark, sf).withColumn("text", _pick(_HINTS, F.col("l_partkey")))
    df = df.withColumn("hint", dr.family_hint(F.col("text")))
    return df.select(*ROW, F.col("hint.family").alias("family"), F.coalesce("hint.brand", dr.brand_hint(F.col("text"))).alias("brand"),
                     F.coalesce("hint.low", F.lit(False)).alias("low"))


RULES = [("red|ring", "a"), ("blue", "b"), ("widget|bolt", "c"), ("small", "d")]


@query("first_match_wins", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|ring') THEN 'a' WHEN regexp_matches(p_name, 'blue') THEN 'b' "
       "WHEN regexp_matches(p_name, 'widget|bolt') THEN 'c' WHEN regexp_matches(p_name, 'small') THEN 'd' END AS rule FROM part")
def first_match_wins(spark, sf):
    part = fr.table(spark, sf, "part")
    return part.select("p_partkey", first_match([(F.col("p_name").rlike(p), v) for p, v in RULES]).alias("rule"))


_FORMS = ["optiplex 7080 sff", "micro tour m90q", "micro tour m90q tiny", "mini pc", "tour i7", "mini tour"]


@query("form_factor_reject", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'sff' WHEN 1 THEN 'micro tour' "
       "WHEN 4 THEN 'tour' WHEN 5 THEN 'mini tour' END AS form FROM lineitem")
def form_factor_reject(spark, sf):
    words = ["sff", "tower", "mini tour", "micro tour", "tour"]
    form = pc.form_factor_reject(_pick(_FORMS, F.col("l_partkey")), words, ["micro", "mini", "tiny"])
    return numbers(spark, sf).select(*ROW, form.alias("form"))


@query("cpu_extract", f"""
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_linenumber % 5 WHEN 0 THEN 'i5-' || (8000 + n * 10) || 'T' WHEN 1 THEN 'i7-' || (10000 + n) WHEN 2 THEN CASE WHEN n >= 2 THEN 'i3 ' || n || 'e gén.' ELSE 'i3' END
      WHEN 3 THEN CASE WHEN n <= 8 THEN 'Ryzen 5 PRO ' || n || '650GE' WHEN n = 9 THEN 'Ryzen 5 PRO 9650GE' ELSE 'i9' END ELSE 'Celeron' END AS cpu,
    CAST(CASE l_linenumber % 5 WHEN 0 THEN 10 WHEN 1 THEN 13 WHEN 2 THEN CASE WHEN n >= 2 THEN n END WHEN 3 THEN CASE WHEN n <= 8 THEN n + 8 END END AS BIGINT) AS score FROM ({NUM_SQL})""")
def cpu_extract(spark, sf):
    """The best of the CPUs quoted; a lesser one stands beside each."""
    df = numbers(spark, sf)
    n, kind = F.col("n"), F.col("l_linenumber") % 5
    title = F.when(kind == 0, _say("pc i5-", n * 10 + 8000, "t ou i3-8100")).when(kind == 1, _say("core i7 ", n + 10000, " / i5-10400")).when(
        kind == 2, _say("pc i3 ", n, "e gen")).when(kind == 3, F.when(n <= 9, _say("ryzen 5 pro ", n, "650ge")).otherwise(F.lit("i9 neuf"))).otherwise(
        F.lit("celeron n4000"))
    df = df.withColumn("cpu", pc.best_cpu(pc.cpu_list(title)))
    return df.select(*ROW, F.col("cpu.label").alias("cpu"), F.col("cpu.score").alias("score"))


@query("memory_extract", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN n WHEN 1 THEN n * 2 WHEN 2 THEN n WHEN 3 THEN NULL ELSE 16 END AS ram,
    CASE l_linenumber % 5 WHEN 0 THEN q * 10 WHEN 1 THEN q * 20 WHEN 2 THEN CASE WHEN n < 10 THEN n * 1000 END WHEN 3 THEN CASE WHEN q * 10 >= 120 OR q >= 1 THEN q * 10 END
      ELSE CASE WHEN q * 40 >= 120 THEN q * 40 END END AS storage,
    CASE l_linenumber % 5 WHEN 0 THEN 'SSD' WHEN 1 THEN 'HDD' WHEN 2 THEN 'SSD NVMe' WHEN 3 THEN 'SSD' ELSE '' END AS kind FROM ({NUM_SQL})""")
def memory_extract(spark, sf):
    df = numbers(spark, sf)
    n, q, kind = F.col("n"), F.col("q"), F.col("l_linenumber") % 5
    text = F.when(kind == 0, _say(n, " go ram - ssd ", q * 10, " go")).when(kind == 1, _say("ddr4 ", n * 2, "go / ", q * 20, " go hdd")).when(
        kind == 2, _say("ram ", n, " gb, ", n, " to nvme")).when(kind == 3, _say("ssd ", q * 10, "gb")).otherwise(_say("pc 16 go ", q * 40, " go"))
    out = pc.memory_extract(df.withColumn("full", text))
    return out.select(*ROW, F.col("memory.ram").alias("ram"), F.col("memory.storage").alias("storage"), F.col("memory.kind").alias("kind"))


