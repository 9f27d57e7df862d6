"""The registered queries of the text-analytics operators and their SQL.

Corpora without Cyrillic run the Cyrillic path through a fixed transliteration
that both engines apply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verba import fixtures
from verba.functions import dates, textnorm
from verba.functions.textnorm import explode_tokens, with_tokens
from verba.operators import analyzer, evaluate, gazetteer, ner, relational_rules
from verba.operators.lookup import Profile
from verba.plans.rules import compile_book, load
from verba.runtime import prepare
from verba.sources import dictionaries, tables

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
#: Queries over fixed vectors: (query, wanted rows).
GOLDEN: dict[str, tuple[Callable, Callable]] = {}

WORD = r"\p{L}+(?:-\p{L}+)*"
TOKEN = WORD + r"|[0-9]+|[^\p{L}0-9\s]"
LATIN, CYRILLIC = "abvgdeziklmnoprstufhcy", "абвгдезиклмнопрстуфхцы"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def golden(columns: str, want: Callable):
    """Register a query over fixed vectors; its oracle is the list of wanted rows."""

    def add(f):
        def quoted(v):
            return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

        QUERIES[f.__name__] = f
        GOLDEN[f.__name__] = (f, want)
        ORACLE[f.__name__] = f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in want())}) as t({columns})"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Costly rows: over all cores if the frame has fewer tasks than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are costly, dealt."""
    return dealt(table(spark, sf_dir, name))


def cyr(col: str = "text"):
    return F.regexp_replace(F.translate(F.lower(col), LATIN, CYRILLIC), "[^а-я ]", " ")


CYR_SQL = f"regexp_replace(translate(lower(text), '{LATIN}', '{CYRILLIC}'), '[^а-я ]', ' ', 'g')"
TOKENS_SQL = f"select doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) raw from documents"


def doc_tokens(spark, sf_dir, *fields: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token of all documents, with the token columns ``fields`` (all, if none is named)."""
    return explode_tokens(with_tokens(texts(spark, sf_dir).select(*keep, "text"), keep=list(keep), fields=fields or textnorm.TOKEN_FIELDS))


# -- tokens and orthography ---------------------------------------------------------------


@query(f"""select kind, count(*) n from (select case when regexp_full_match(raw, '{WORD}') then 'word' when regexp_full_match(raw, '[0-9]+') then 'number'
    when regexp_full_match(raw, '\\p{{P}}') then 'punct' else 'symbol' end kind from ({TOKENS_SQL})) group by 1""")
def token_counts_by_kind(spark, sf_dir):
    return doc_tokens(spark, sf_dir, "kind", keep=()).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"select page_id, count(*) tokens from (select page_id, unnest(regexp_extract_all(html, '{TOKEN}')) raw from pages) group by 1")
def token_counts_pages(spark, sf_dir):
    t = with_tokens(table(spark, sf_dir, "pages").select("page_id", "html"), text_col="html", fields=("kind",))
    return t.select("page_id", F.size("tokens").cast("long").alias("tokens"))


@query(f"""with w as (select raw, regexp_replace(raw, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g') b from ({TOKENS_SQL}) where regexp_full_match(raw, '{WORD}'))
    select c, count(*) n from (select case when b = '' then 'none' when not regexp_matches(b, '\\p{{Lu}}') then 'lower' when not regexp_matches(b, '\\p{{Ll}}') and length(b) > 1 then 'upper'
    when regexp_full_match(b, '\\p{{Lu}}\\p{{Ll}}*') or regexp_full_match(raw, '\\p{{Lu}}[^\\p{{Lu}}-]*(-\\p{{Lu}}[^\\p{{Lu}}-]*)*') then 'title' else 'mixed' end c from w) group by 1""")
def token_case_histogram(spark, sf_dir):
    return doc_tokens(spark, sf_dir, "kind", "case", keep=()).where("kind = 'word'").groupBy(F.col("case").alias("c")).agg(F.count("*").alias("n"))


@query(f"select raw, count(*) n from ({TOKENS_SQL}) where regexp_full_match(raw, '{WORD}') group by 1")
def fast_words(spark, sf_dir):
    """The SQL-only tokeniser, for texts without marks and mixed scripts."""
    docs = texts(spark, sf_dir)
    return docs.select(F.explode(textnorm.fast_tokens(F.col("text"))).alias("raw")).where(F.col("raw").rlike(r"^\p{L}")).groupBy("raw").agg(F.count("*").alias("n"))


@query("select lang, count(*) docs, 0::bigint bad from documents group by 1")
def token_offsets_contract(spark, sf_dir):
    """Each token's code-point and byte offsets cut its own text out of the document."""
    docs = texts(spark, sf_dir).select("doc_id", "lang", "text")
    t = with_tokens(docs.withColumn("src", F.col("text")), keep=["doc_id", "lang", "src"], fields=("raw", "start", "end", "rune_start", "rune_end"))
    bad = "size(filter(tokens, t -> substring(src, t.rune_start + 1, t.rune_end - t.rune_start) <> t.raw or octet_length(t.raw) <> t.end - t.start))"
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.expr(bad)).cast("long").alias("bad"))


@query("select doc_id, len(regexp_extract_all(text, '[.!?;…]'))::bigint ends from documents")
def sentence_counts(spark, sf_dir):
    t = with_tokens(texts(spark, sf_dir).select("doc_id", "text"), fields=("kind", "sentence_end"))
    return t.select("doc_id", F.expr("cast(size(filter(tokens, t -> t.sentence_end and t.kind = 'punct')) as bigint)").alias("ends"))


@query(r"select doc_id, len(regexp_extract_all(text, '\p{L}\.'))::bigint dotted from documents")
def dotted_words(spark, sf_dir):
    t = with_tokens(texts(spark, sf_dir).select("doc_id", "text"), fields=("dotted",))
    return t.select("doc_id", F.expr("cast(size(filter(tokens, t -> t.dotted)) as bigint)").alias("dotted"))


@query(f"select distinct raw, strip_accents(lower(raw)) form from ({TOKENS_SQL}) where regexp_full_match(raw, '{WORD}')")
def orthography_latin(spark, sf_dir):
    docs = texts(spark, sf_dir)
    raw = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("raw")).distinct()
    return textnorm.normalized(raw, "raw", "form")


@query(f"""with p as (select raw, list_transform(range(0, len(string_split(raw, '-'))), lambda i: i) ix, string_split(raw, '-') ps from (select distinct raw from ({TOKENS_SQL}) where regexp_full_match(raw, '\\p{{L}}+(-\\p{{L}}+)+')))
    select raw, unnest(ps) part, unnest(ix)::int i from p""")
def hyphen_parts(spark, sf_dir):
    t = doc_tokens(spark, sf_dir, "kind", "raw", keep=()).where("kind = 'word' and raw like '%-%'").select("raw").distinct()
    return t.select("raw", F.posexplode(F.split("raw", "-")).alias("i", "part"))


@query("select doc_id, length(text)::bigint units from documents")
def utf16_offsets(spark, sf_dir):
    """UTF-16 offset of each text's end."""
    return texts(spark, sf_dir).select("doc_id", (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long").alias("units"))


_SUFFIXES = ("яго", "аго", "ыя", "ия")


@query(f"""with w as (select distinct unnest(string_split({CYR_SQL}, ' ')) w from documents), f as (select w || s form from w, (values ('яго'), ('аго'), ('ыя'), ('ия')) t(s) where w <> ''),
    v as (select form, left(form, length(form) - 3) s3, left(form, length(form) - 2) s2 from f)
    select form, case when form like '%яго' then s3 || 'его' when form like '%аго' then case when regexp_matches(s3, '[жшчщ]$') then s3 || 'ого,' || s3 || 'его' else s3 || 'ого' end
    when form like '%ыя' then s2 || 'ые,' || s2 || 'ой' when regexp_matches(s2, '[кгх]$') then s2 || 'ие,' || s2 || 'ой' else s2 || 'ие,' || s2 || 'ей' end variants from v""")
def reform_variants(spark, sf_dir):
    w = texts(spark, sf_dir).select(F.explode(F.split(cyr(), " ")).alias("w")).where("w <> ''").distinct()
    f = w.select(F.explode(F.array(*(F.concat("w", F.lit(s)) for s in _SUFFIXES))).alias("form"))
    return f.select("form", F.array_join(F.expr(textnorm.reform_variants_sql("form")), ",").alias("variants"))


@query("select event_type kind, regexp_full_match(event_type, '[a-z][a-z0-9_]*') ok, count(*) n from events group by 1, 2 union all select p_brand, regexp_full_match(p_brand, '[a-z][a-z0-9_]*'), count(*) from part group by 1, 2")
def kind_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")).unionAll(table(spark, sf_dir, "part").select("p_brand"))
    return rows.groupBy("kind", F.col("kind").rlike(r"^[a-z][a-z0-9_]*\z").alias("ok")).agg(F.count("*").alias("n"))


# -- analyser --------------------------------------------------------------------------------


@query(f"select strip_accents(lower(raw)) form, count(*) n, count(distinct doc_id) docs from ({TOKENS_SQL}) where regexp_full_match(raw, '{WORD}') group by 1")
def term_document_frequency(spark, sf_dir):
    """Terms of all words and the documents that hold them; partial sums by batch keep the shuffle small."""
    return textnorm.form_counts(texts(spark, sf_dir))


def _cyr_forms(spark, sf_dir):
    """A dictionary made of the transliterated corpus: words of five letters and more; the lemma is the first five letters."""
    words = texts(spark, sf_dir).select(F.explode(F.split(cyr(), " ")).alias("form")).where("char_length(form) >= 5").distinct()
    own = lambda lemma: F.struct(F.lit(0).alias("dict_ord"), F.lit("base.corpus").alias("dict"), F.lit("base").alias("kind"), F.col("form").alias("form_key"), F.col("form"), lemma.alias("lemma"), F.lit("NOUN").alias("tag"), F.lit(0).cast("long").alias("lexeme_id"), F.char_length(lemma).cast("long").alias("form_ord"), F.lit(False).alias("predicted"))
    return words.select(F.explode(F.array(own(F.left("form", F.lit(4))), own(F.left("form", F.lit(5))))).alias("x")).select("x.*")


@query(f"""with w as (select doc_id, unnest(string_split({CYR_SQL}, ' ')) form from documents), l as (select doc_id, unnest(case when length(form) >= 5 then [left(form, 4), left(form, 5)] else [form] end) lemma from w where form <> '')
    select lemma, count(*) n, count(distinct doc_id) docs from l group by 1""")
def index_terms_cyr(spark, sf_dir):
    """Lemma frequencies of the transliterated corpus: each distinct form is looked up once."""
    docs = texts(spark, sf_dir).select("doc_id", cyr().alias("text"))
    t = analyzer.analyze(docs, _cyr_forms(spark, sf_dir), Profile("text"), textnorm.MODERN, analyzer.INDEX, fields=("raw", "form", "start", "end", "rune_start", "rune_end", "kind", "script", "dotted", "sentence_end"))
    per = t.select("doc_id", F.explode("lemmas.text").alias("lemma")).groupBy("lemma", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("lemma").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def golden_forms(spark: SparkSession) -> DataFrame:
    kinds = {"base": 0, "abbrev": 1, "surname": 2}
    rows = [(0, f"{k}.test", k, f, f, n, t, 0, i, p == "*") for i, (f, n, t, k, p) in enumerate(fixtures.rows(fixtures.READINGS))]
    assert {r[2] for r in rows} <= set(kinds)
    return prepare(spark).createDataFrame(rows, dictionaries.FORMS_SCHEMA)


def _shown(terms: DataFrame, *by: str) -> DataFrame:
    one = F.struct("idx", "part", F.when(F.size("lemmas") > 0, F.concat("term", F.lit("="), analyzer.shown())).otherwise(F.col("raw")).alias("s"))
    return terms.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "; ").alias("terms"))


@golden("profile, text, terms", lambda: [tuple(r) for r in fixtures.rows(fixtures.INDEX_CASES)])
def analyze_index_golden(spark, sf_dir):
    docs, forms, out = prepare(spark).createDataFrame(fixtures.rows(fixtures.INDEX_CASES), "profile string, text string, terms string"), golden_forms(spark), None
    for name, p in fixtures.PROFILES.items():
        own = docs.where(F.col("profile") == name).select("profile", F.col("text").alias("src"), "text")
        got = _shown(analyzer.analyze(own, forms, p, mode=analyzer.INDEX, keep=["profile", "src"]), "profile", "src")
        out = got if out is None else out.unionByName(got)
    return out.select("profile", F.col("src").alias("text"), "terms")


@golden("text, terms", lambda: [tuple(r) for r in fixtures.rows(fixtures.FULL_CASES)])
def analyze_full_golden(spark, sf_dir):
    docs = prepare(spark).createDataFrame([(r[0], r[0]) for r in fixtures.rows(fixtures.FULL_CASES)], "src string, text string")
    return _shown(analyzer.analyze(docs, golden_forms(spark), fixtures.PROFILES["text"]), "src").select(F.col("src").alias("text"), "terms")


@golden("query, terms, partial", lambda: [tuple(r) for r in fixtures.rows(fixtures.QUERY_CASES)])
def parse_query_golden(spark, sf_dir):
    q = prepare(spark).createDataFrame([(r[0], r[0]) for r in fixtures.rows(fixtures.QUERY_CASES)], "query string, text string")
    t = analyzer.parse_queries(q, golden_forms(spark), fixtures.PROFILES["text"]).withColumn("s", F.concat("term", F.lit("="), analyzer.shown()))
    done = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("partial"), F.struct("idx", "part", "s")))), lambda x: x["s"]), "; ")
    return t.groupBy("query").agg(done.alias("terms"), F.coalesce(F.max(F.when(F.col("partial"), F.col("s"))), F.lit("-")).alias("partial"))


@golden("word, kinds, src, want, forms", lambda: [tuple(r) for r in fixtures.rows(fixtures.INFLECT_CASES)])
def inflect_forms(spark, sf_dir):
    c = inflect_catalog(prepare(spark))
    words = lambda col: F.filter(F.split(col, " "), lambda x: x != "")
    req = spark.createDataFrame(fixtures.rows(fixtures.INFLECT_CASES), "word string, kinds string, src string, want string, forms string").drop("forms")
    req = req.withColumn("id", F.concat_ws("|", "word", "kinds", "src", "want"))
    got = dictionaries.inflect(req.select("id", "word", words("kinds").alias("kinds"), words("src").alias("from"), words("want").alias("want")), c.forms())
    return req.join(got, "id").select("word", "kinds", "src", "want", F.coalesce(F.array_join("forms", " "), F.lit("")).alias("forms"))


def inflect_catalog(spark) -> dictionaries.Catalog:
    custom = [tuple(x.replace("ё", "е") for x in r) for r in fixtures.rows(fixtures.INFLECT_CUSTOM)]
    return dictionaries.Catalog.open(spark, base=map(tuple, fixtures.rows(fixtures.INFLECT_BASE)), builtins={"custom.terms": custom}, kinds=["custom"])


@query("""with d(ord, name, kind, rows) as (values (0, 'base.builtin', 'base', 13), (1, 'custom.terms', 'custom', 2)) select kind, 1::bigint dictionaries, rows::bigint forms from d""")
def registry_summary(spark, sf_dir):
    return inflect_catalog(prepare(spark)).summary()


@query("""select n, case when m between 11 and 14 then 'gent,plur' when m % 10 = 1 then 'nomn,sing' when m % 10 between 2 and 4 then 'gent,sing' else 'gent,plur' end g, c
    from (select -l_orderkey % 100 n, abs(-l_orderkey % 100) m, count(*) c from lineitem group by 1, 2)""")
def numeral_grammemes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((-F.col("l_orderkey") % 100).alias("n")).agg(F.count("*").alias("c"))
    return rows.select("n", F.array_join(dates.numeral_grammemes(F.col("n")), ",").alias("g"), "c")


# -- dates -----------------------------------------------------------------------------------


@query("select o_orderkey, cast(o_orderdate as date) d from orders")
def dates_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("text"))
    x = dates.parse_dates(o, "text")
    return x.select("o_orderkey", F.make_date("date.year", "date.month", "date.day").alias("d"))


@query("select o_orderkey, cast(o_orderdate as date) d from orders")
def dates_words(spark, sf_dir):
    genitive = F.array(*(F.lit(w.split()[1] if n != 3 else "марта") for n, w in dates.MONTHS.items()))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.get(genitive, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string"), F.lit("года")).alias("text"))
    x = dates.parse_dates(o, "text")
    return x.select("o_orderkey", F.make_date("date.year", "date.month", "date.day").alias("d"))


@golden("text, ctx, d", lambda: [(t, int(c), d) for t, c, d in fixtures.rows(fixtures.DATES)])
def dates_golden(spark, sf_dir):
    df = prepare(spark).createDataFrame([(t, int(c)) for t, c, _ in fixtures.rows(fixtures.DATES)], "text string, ctx int")
    x = dates.parse_dates(df, "text", F.col("ctx"))
    shown = F.concat(F.format_string("%d-%d-%d", "date.year", "date.month", "date.day"), F.when(F.col("date.year_from_context"), "*").otherwise(""))
    return x.select("text", "ctx", F.coalesce(F.when(F.col("date").isNotNull(), shown), F.lit("")).alias("d"))


# -- sources ------------------------------------------------------------------------------------

_MANIFEST = [("a", 1, "# note"), ("a", 2, "Source: OpenCorpora"), ("a", 3, "no colon"), ("a", 4, "license: CC0"), ("a", 5, "x: 1"), ("b", 1, "source: Own: two"), ("b", 2, "url: http://h"), ("b", 3, "y: 2"), ("b", 4, "")]


@golden("file, body, merged", lambda: [("a", "source: OpenCorpora\nlicense: CC0\nx: 1", "source: OpenCorpora\nlicense: CC0\nurl: http://h\nx: 1\ny: 2"), ("b", "source: Own: two\nurl: http://h\ny: 2", "source: OpenCorpora\nlicense: CC0\nurl: http://h\nx: 1\ny: 2")])
def manifests(spark, sf_dir):
    """Parsed, written again, and merged with file a first."""
    m = dictionaries.manifest_fields(prepare(spark).createDataFrame(_MANIFEST, "file string, line_no int, line string"), ["file"])
    one = lambda f: m.where(F.col("file") == f).select(F.struct(*(c for c in m.columns if c != "file")).alias(f))
    both = one("a").join(one("b")).select(*dictionaries.merge_manifests("a", "b")).select(dictionaries.manifest_text().alias("merged"))
    return m.select("file", dictionaries.manifest_text().alias("body")).join(both)


_LINES = ["# note", "place\tp:1\tКиев\tКиев", "place\tp:1\t\tг. Киев\tcase_sensitive, blocked\tk=v; n=1", "bad", "\tp:2\tx\ty", "place\tp:3\tx\ty\tnone", "", "place\tp:4\tx\ty\t\t=v"]


@golden("line_no, type, canonical, flags, attrs, fault", lambda: [(2, "place", "Киев", 0, "", None), (3, "place", "г. Киев", 12, "k=v;n=1", None), (4, None, None, None, None, "want 4 to 6 fields, got 1"), (5, None, None, None, None, "no type"), (6, None, None, None, None, "unknown flag"), (8, None, None, None, None, "an attribute is key=value")])
def gazetteer_tsv(spark, sf_dir):
    good, bad = tables.gazetteer_lines(prepare(spark).createDataFrame([("s", i, x) for i, x in enumerate(_LINES, 1)], "source string, line_no int, line string"))
    none = lambda kind: F.lit(None).cast(kind)
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return good.select(F.col("entry_ord").cast("int").alias("line_no"), "type", "canonical", "flags", attrs.alias("attrs"), none("string").alias("fault")).unionByName(bad.select("line_no", none("string").alias("type"), none("string").alias("canonical"), none("int").alias("flags"), none("string").alias("attrs"), "fault"))


# -- gazetteer ----------------------------------------------------------------------------------


def part_entries(spark, sf_dir) -> DataFrame:
    """Part names as aliases; the reference is the brand."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entry_ord"), F.min("p_brand").alias("ref"))
    return p.select(F.lit("part").alias("source"), "entry_ord", F.col("p_name").alias("alias"), F.lit("part").alias("type"), "ref", F.lit("").alias("canonical"), F.expr("cast(map() as map<string,string>)").alias("attrs"), F.lit(0).alias("flags"))


def rows_apart(spark, sf_dir) -> DataFrame:
    """The documents, dealt, with ``doc``, which tells rows apart whose id is null or repeats.

    Rows are numbered as they are read: once dealt, they come in any order, and a plan
    that uses them twice would give one row two numbers.
    """
    return dealt(table(spark, sf_dir, "documents").withColumn("doc", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))))


def no_forms(spark) -> DataFrame:
    return prepare(spark).createDataFrame([], dictionaries.FORMS_SCHEMA)


@query(f"""with p as (select p_name, min(p_partkey) e from part group by 1), k as (select e, array_to_string(list_transform(regexp_extract_all(p_name, '{WORD}|[0-9]+'), lambda x: strip_accents(lower(x))), ' ') key from p)
    select 'part#' || e alias_id, kind key_kind, key, len(string_split(key, ' '))::int n_words from k, (values ('lemma'), ('surface')) t(kind) where key <> ''""")
def alias_keys(spark, sf_dir):
    return gazetteer.keys(gazetteer.compile_entries(part_entries(spark, sf_dir), no_forms(spark), {}, Profile("text")))


_FREQ = f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) raw, unnest(range(1, len(regexp_extract_all(text, '{TOKEN}')) + 1)) idx from documents where lang = 'en'),
    d as (select *, length(raw) = 1 and lead(raw) over w = '.' as short, sum((raw = '.')::int) over w dots, regexp_full_match(raw, '{WORD}|[0-9]+') word from t window w as (partition by doc_id order by idx)),
    n as (select doc_id, idx, strip_accents(lower(raw)) f, short, dots, lead(idx) over w nidx, lead(dots) over w ndots, lead(strip_accents(lower(raw))) over w nf from d where word window w as (partition by doc_id order by idx)),
    c as (select doc_id, f, nf, case when short then nidx - idx - 1 = ndots - dots else nidx = idx + 1 end nw from n where nidx is not null),
    b as (select f || ' ' || nf k from c where nw group by 1 having count(*) >= 20)"""


@query(_FREQ + " select doc_id, k alias, count(*) n from (select doc_id, f || ' ' || nf k from c where nw) join b using (k) group by 1, 2")
def surface_matches(spark, sf_dir):
    """Runs of one to three words that occur 20 times or more as aliases, matched in all texts."""
    docs = rows_apart(spark, sf_dir).select("doc", "text")
    t = explode_tokens(with_tokens(docs)).withColumns({"term": F.col("form"), "lemmas": F.expr("array(named_struct('text', form, 'flags', 4, 'tag', '', 'kind', '', 'dict', ''))")})
    t = t.withColumn("dotted", F.coalesce(F.lead("raw").over(Window.partitionBy("doc").orderBy("idx")) == ".", F.lit(False)))  # as the SQL has it, numbers too
    pos = gazetteer.positions(t, "doc")
    aliases = gazetteer.runs(pos, 3, "doc").groupBy("key").agg(F.count("*").alias("n")).where("n >= 20")
    hits = gazetteer.surface_matches(pos, aliases.select("key", F.col("key").alias("alias_id"), F.lit("surface").alias("key_kind")), 3, "doc")
    return hits.groupBy(F.col("doc.doc_id").alias("doc_id"), F.col("alias_id").alias("alias")).agg(F.count("*").alias("n"))


@query(f"""with t as (select doc_id, {CYR_SQL} c from documents), s as (select doc_id, list_filter(string_split(c, ' '), lambda x: x <> '') l from t),
    e as (select doc_id, unnest(l) f, unnest(range(1, len(l) + 1)) i from s),
    o as (select doc_id, i, unnest(case when length(f) >= 5 then [left(f, 4), left(f, 5)] else [f] end) m from e),
    k as (select distinct a.m || ' ' || b.m key from o a join o b on a.doc_id = b.doc_id and b.i = a.i + 1 where a.doc_id % 50 = 0 and length(a.m) = 4 and length(b.m) = 4)
    select a.doc_id, a.m || ' ' || b.m key, count(*) n from o a join o b on a.doc_id = b.doc_id and b.i = a.i + 1 join k on k.key = a.m || ' ' || b.m group by 1, 2""")
def lemma_matches(spark, sf_dir):
    """All lemma pairs of all texts as keys, matched over ambiguous words by the level-wise trie join."""
    docs = rows_apart(spark, sf_dir).select("doc", cyr().alias("text"))
    t = analyzer.analyze(docs, _cyr_forms(spark, sf_dir), Profile("text"), textnorm.MODERN)
    pos = gazetteer.positions(t, "doc")
    w = Window.partitionBy("doc").orderBy("pos")
    near = pos.withColumn("next", F.lead("options").over(w)).where("not brk")
    keys = near.select(F.explode("options").alias("a"), "next").select("a", F.explode("next").alias("b")).select(F.concat_ws(" ", "a", "b").alias("key")).distinct()
    hits = gazetteer.lemma_matches(pos, keys.select("key", F.lit("lemma").alias("key_kind"), F.col("key").alias("alias_id"), F.lit(2).alias("n_words")), "doc")
    return hits.groupBy(F.col("doc.doc_id").alias("doc_id"), F.col("alias_id").alias("key")).agg(F.count("*").alias("n"))


def nation_entries(spark, sf_dir) -> DataFrame:
    """Nation names as aliases, grouped by region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.lit("nation").alias("source"), F.col("n_nationkey").cast("long").alias("entry_ord"), F.col("n_name").alias("alias"), F.lit("nation").alias("type"), F.concat(F.lit("r:"), "n_regionkey").alias("ref"), F.col("r_name").alias("canonical"), F.expr("cast(map() as map<string,string>)").alias("attrs"), F.lit(0).alias("flags"))


_NATION = f"select array_to_string(list_transform(regexp_extract_all(n_name, '{WORD}|[0-9]+'), lambda x: strip_accents(lower(x))), ' ') key, r_name, n_regionkey from nation join region on n_regionkey = r_regionkey"


@query(f"select key, array_to_string(list_sort(list_distinct(list(r_name))), ',') forms from ({_NATION}) group by 1")
def variant_canonical(spark, sf_dir):
    c = gazetteer.compile_entries(nation_entries(spark, sf_dir), no_forms(spark), {}, Profile("text"))
    return gazetteer.canonical_forms(c).select("key", F.array_join("forms", ",").alias("forms"))


@query(f"with k as ({_NATION}) select a.key lemma, array_to_string(list_sort(list_distinct(list(b.key))), ',') expanded from k a join k b using (n_regionkey) group by 1")
def variant_expand(spark, sf_dir):
    c = gazetteer.compile_entries(nation_entries(spark, sf_dir), no_forms(spark), {}, Profile("text"))
    return gazetteer.variants(c).select("lemma", F.array_join("expanded", ",").alias("expanded"))


# -- extraction -----------------------------------------------------------------------------------


def golden_catalog(spark) -> dictionaries.Catalog:
    by = {k: [(n, f, t) for kind, n, t, fs in fixtures.rows(fixtures.VOCABULARY) if kind == k for f in fs.split()] for k in fixtures.KINDS}
    return dictionaries.Catalog.open(prepare(spark), base=by.pop("base"), builtins={f"{k}.test": v for k, v in by.items()}, kinds=fixtures.KINDS, predictions=fixtures.PREDICTED)


def golden_compiled(spark, forms) -> DataFrame:
    lines = [("test", i, "\t".join(r)) for i, r in enumerate(fixtures.rows(fixtures.ENTRIES), 1)]
    good, _ = tables.gazetteer_lines(spark.createDataFrame(lines, "source string, line_no int, line string"))
    return gazetteer.compile_entries(good, forms, {t: fixtures.NER_PROFILES[p] for t, p in fixtures.TYPE_PROFILES.items()}, fixtures.NER_PROFILES["text"])


def golden_results(spark) -> DataFrame:
    forms = golden_catalog(spark).forms()
    docs = spark.createDataFrame([(i, [t for t in g.split(",") if t], x) for i, g, x, _ in fixtures.rows(fixtures.DOCUMENTS)], "doc_id string, tags array<string>, text string")
    p = ner.Pipeline(fixtures.NER_PROFILES, "text", compile_book(load(fixtures.RULES)), nesting=fixtures.NESTING, explain=True)
    return ner.extract_documents(docs, golden_compiled(spark, forms), forms, p)


def golden_spans(spark) -> DataFrame:
    return ner.spans(golden_results(spark))


@golden("doc_id, spans", lambda: [(i, s) for i, _, _, s in fixtures.rows(fixtures.DOCUMENTS)])
def bulletin_spans(spark, sf_dir):
    return golden_results(prepare(spark)).select("doc_id", F.array_join(F.transform("spans", lambda s: F.concat(s["type"], F.lit(":"), s["surface"])), "; ").alias("spans"))


@golden("doc_id, surface, score, flags, normal, others", lambda: [tuple(r) for r in fixtures.rows(fixtures.DETAILS)])
def span_details(spark, sf_dir):
    """Scores, flags, normals and alternatives: boosts, relabels, ties, nesting, predicted and absorbed words."""
    want = spark.createDataFrame([tuple(r[:2]) for r in fixtures.rows(fixtures.DETAILS)], "doc_id string, surface string")
    got = golden_spans(prepare(spark)).join(want, ["doc_id", "surface"])
    return got.select("doc_id", "surface", F.format_string("%.2f", "score").alias("score"), F.col("flags").cast("string").alias("flags"), F.array_join("normal", ",").alias("normal"), F.array_join(F.transform("alternatives", lambda a: a["type"]), ",").alias("others"))


@golden("doc_id, kind, args, rule", lambda: [("level", "measured", "at=0,level=1", "levels/level")])
def facts_golden(spark, sf_dir):
    args = F.array_join(F.array_sort(F.transform(F.map_entries("args"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return ner.facts(golden_results(prepare(spark))).select("doc_id", "kind", args.alias("args"), "rule")


@golden("source, entries, aliases, lemma_keys, surface_keys, capped, blocked, skipped", lambda: [("test", 11, 11, 10, 11, 0, 1, 0)])
def compile_report(spark, sf_dir):
    return gazetteer.report(golden_compiled(prepare(spark), golden_catalog(spark).forms()))


#: Function words, each of one language only.
FUNCTION_WORDS = {"en": ("the", "of", "and"), "fr": ("les", "une", "pour"), "de": ("der", "und", "mit"), "es": ("los", "del", "con")}


@query(f"""with w(lang, form) as (values {", ".join(f"('{k}', '{w}')" for k, ws in FUNCTION_WORDS.items() for w in ws)})
    select w.lang as type, raw surface, count(*) n, 3.0::double score from ({TOKENS_SQL}) join w on strip_accents(lower(raw)) = form group by 1, 2""")
def entity_spans_documents(spark, sf_dir):
    """Spans of function words, typed by language, over all texts: matching, scoring, resolution and output."""
    docs = texts(spark, sf_dir).select("doc_id", "text")
    rows = [("words", i, w, lang, f"{lang}:{w}", w, {}, 0) for i, (lang, w) in enumerate((k, w) for k, ws in FUNCTION_WORDS.items() for w in ws)]
    forms = no_forms(spark)
    compiled = gazetteer.compile_entries(spark.createDataFrame(rows, tables.ENTRY_SCHEMA), forms, {}, Profile("text"))
    got = ner.extract_documents(docs, compiled, forms, ner.Pipeline({"text": Profile("text")}, "text"))
    return ner.spans(got).groupBy("type", "surface").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


# -- evaluation --------------------------------------------------------------------------------------

_GOLD = [("1", 0, 0, 5, "a"), ("1", 1, 6, 9, "b"), ("2", 0, 0, 4, "a"), ("2", 1, 0, 4, "a")]
_PRED = [("1", 0, 0, 4, "a"), ("1", 1, 6, 9, "b"), ("2", 0, 0, 4, "a"), ("2", 1, 2, 9, "a"), ("2", 2, 3, 4, "a"), ("3", 0, 0, 1, "c")]


def _scored(spark):
    make = lambda rows: prepare(spark).createDataFrame(rows, "case_id string, ord int, start int, end int, type string")
    return make(_GOLD), make(_PRED)


@golden("type, tp, fp, fn", lambda: [("a", 1, 3, 2), ("b", 1, 0, 0), ("c", 0, 1, 0)])
def golden_strict_scores(spark, sf_dir):
    return evaluate.strict_counts(*_scored(spark))


@golden("type, tp, fp, fn", lambda: [("a", 3, 1, 0), ("b", 1, 0, 0), ("c", 0, 1, 0)])
def golden_partial_scores(spark, sf_dir):
    return evaluate.partial_counts(*_scored(spark))


@query("""with c(type, tp, fp, fn) as (values ('a', 1, 3, 2), ('b', 1, 0, 0), ('c', 0, 1, 0)), r as (select *, case when tp + fp = 0 then 1.0 else tp::double / (tp + fp) end p, case when tp + fn = 0 then 1.0 else tp::double / (tp + fn) end r from c)
    select type, round(p, 6) p, round(r, 6) r, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) f1 from r""")
def golden_prf(spark, sf_dir):
    x = evaluate.rates(evaluate.strict_counts(*_scored(spark)))
    return x.select("type", F.round("precision", 6).alias("p"), F.round("recall", 6).alias("r"), F.round("f1", 6).alias("f1"))

# -- more golden vectors and relational rule stages --------------------------------------------------

_SPELLED = [("Ивановъ", "ивановъ", "иванов"), ("Покровскій", "покровский", "покровский"), ("Ѳеодоръ", "феодоръ", "феодор"), ("Iоаннъ", "иоаннъ", "иоанн"), ("Бѣлёвъ", "белевъ", "белев"), ("кр‐нин", "кр-нин", "кр-нин"), ("Mississippi", "mississippi", "mississippi"), ("Kот", "кот", "кот"), ("Kотw", "kотw", "kотw"), ("Санктъ-Петербургъ", "санктъ-петербургъ", "санкт-петербург")]


@golden("text, spelled, word", lambda: _SPELLED)
def orthography_prereform(spark, sf_dir):
    df = prepare(spark).createDataFrame([(x[0],) for x in _SPELLED], "text string")
    return textnorm.normalized(textnorm.normalized(df, "text", "spelled", word=False), "text", "word")


_REPAIRED = [("Kот", "Kот/cyrillic/кот"), ("Kотw", "K/latin/k от/cyrillic/от w/latin/w"), ("Iоаннъ", "Iоаннъ/cyrillic/иоанн"), ("XIX-го", "XIX/latin/xix -/none/ го/cyrillic/го"), ("Kот-Smith", "Kот/cyrillic/кот -/none/ Smith/latin/smith"), ("αβγ", "αβγ/mixed/αβγ")]


@golden("src, tokens", lambda: _REPAIRED)
def homoglyph_repair(spark, sf_dir):
    t = with_tokens(prepare(spark).createDataFrame([(x[0], x[0]) for x in _REPAIRED], "src string, text string"))
    return t.select("src", F.array_join(F.transform("tokens", lambda x: F.concat_ws("/", x["raw"], x["script"], x["form"])), " ").alias("tokens"))


_READINGS = [("кот", "base", "NOUN,anim,masc sing,nomn"), ("иван", "base", "NOUN,anim,masc,Name sing,nomn"), ("в", "base", "PREP"), ("с", "base", "PREP"), ("с", "abbrev", "NOUN,Abbr"), ("и", "base", "CONJ"), ("и", "base", "INTJ"), ("мороз", "surname", "Surn"), ("сурн", "base", "NOUN;Surname")]
_READ_SQL = "(values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _READINGS) + ") t(form, kind, tag)"


@query(f"select form, kind, tag, kind <> 'base' or list_has_any(regexp_split_to_array(tag, '[,; ]'), ['Name', 'Surn', 'Patr']) keep from {_READ_SQL}")
def profile_filter(spark, sf_dir):
    df = prepare(spark).createDataFrame(_READINGS, "form string, kind string, tag string")
    return df.withColumn("keep", relational_rules.keeps(F.col("kind"), F.col("tag"), {"base": ("Name", "Surn", "Patr")}))


@query(f"select form, coalesce(bool_and(regexp_split_to_array(tag, '[,; ]')[1] in ('PREP', 'CONJ', 'PRCL', 'INTJ')) filter (where not list_contains(regexp_split_to_array(tag, '[,; ]'), 'Abbr')), false) stop from {_READ_SQL} group by 1")
def stop_words(spark, sf_dir):
    df = prepare(spark).createDataFrame(_READINGS, "form string, kind string, tag string")
    return df.groupBy("form").agg(F.collect_list("tag").alias("tags")).select("form", relational_rules.all_service(F.col("tags")).alias("stop"))


@query("""with o(id, a, b, c) as (values (1, ['x'], ['y'], ['z']), (2, ['a', 'b'], ['c', 'd'], ['e', 'f', 'g']), (3, ['p', 'q', 'r'], ['s', 't', 'u'], ['v'])),
    f as (select id, a[i] || ' ' || b[j] || ' ' || c[k] key, row_number() over (partition by id order by i, j, k) n from o, unnest(range(1, len(a) + 1)) t(i), unnest(range(1, len(b) + 1)) u(j), unnest(range(1, len(c) + 1)) v(k))
    select id, key, n::int n from f where n <= 8""")
def lemma_combinations(spark, sf_dir):
    rows = [(1, [["x"], ["y"], ["z"]]), (2, [["a", "b"], ["c", "d"], ["e", "f", "g"]]), (3, [["p", "q", "r"], ["s", "t", "u"], ["v"]])]
    df = prepare(spark).createDataFrame(rows, "id int, options array<array<string>>")
    return df.select("id", F.posexplode(F.expr(gazetteer._COMBINE)).alias("n", "k")).select("id", F.array_join("k", " ").alias("key"), (F.col("n") + 1).alias("n"))


@query("""with s(name, w) as (values ('all', cast([] as varchar[])), ('old', ['period:old']), ('both', ['period:old', 'lang:ru'])), d(id, t) as (values (1, cast([] as varchar[])), (2, ['period:old']), (3, ['lang:ru', 'period:old']))
    select id, name from s, d where list_has_all(t, w)""")
def tag_activation(spark, sf_dir):
    docs = prepare(spark).createDataFrame([(1, []), (2, ["period:old"]), (3, ["lang:ru", "period:old"])], "id int, tags array<string>")
    return relational_rules.active(docs, {"all": (), "old": ("period:old",), "both": ("period:old", "lang:ru")}).select("id", "name")


def _positions(spark, sf_dir) -> DataFrame:
    t = doc_tokens(spark, sf_dir).withColumns({"term": F.col("form"), "lemmas": F.expr("array(named_struct('text', form, 'flags', 4, 'tag', '', 'kind', '', 'dict', ''))")})
    return gazetteer.positions(t)


_POS = f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) raw, unnest(range(1, len(regexp_extract_all(text, '{TOKEN}')) + 1)) idx from documents),
    d as (select *, length(raw) = 1 and lead(raw) over w = '.' as short, sum((raw = '.')::int) over w dots, regexp_full_match(raw, '{WORD}|[0-9]+') word from t window w as (partition by doc_id order by idx)),
    p as (select doc_id, raw, strip_accents(lower(raw)) f, row_number() over w pos, case when short then lead(idx) over w - idx - 1 = lead(dots) over w - dots else lead(idx) over w = idx + 1 end j from d where word window w as (partition by doc_id order by idx))"""


@query(_POS + " select c.doc_id, count(*) hints from p k join p c on c.doc_id = k.doc_id and c.pos in (k.pos + 1, k.pos + 2) left join p m on m.doc_id = k.doc_id and m.pos = k.pos + 1 where k.f = 'the' and c.f = 'of' and k.j and (c.pos = k.pos + 1 or m.j) group by 1")
def hint_boosts(spark, sf_dir):
    """How often the keyword 'the' reaches the word 'of' within two words to the right."""
    got = relational_rules.hint_boosts(_positions(spark, sf_dir), F.col("term") == "the", F.col("term") == "of", 2)
    return got.groupBy("doc_id").agg(F.sum("hints").alias("hints"))


@query(_POS + r""", u as (select *, regexp_full_match(raw, '\p{Ll}{9,}') ok from p), l as (select doc_id, f, j, lead(j) over w j2, lead(ok) over w o1, lead(ok, 2) over w o2 from u window w as (partition by doc_id order by pos))
    select n::int n, count(*) c from (select case when j and o1 then case when j2 and o2 then 2 else 1 end else 0 end n from l where f in ('in', 'la', 'der', 'de')) where n >= 1 group by 1""")
def trigger_candidates(spark, sf_dir):
    """Up to two long lower-case words after a preposition or article."""
    long_word = (F.col("kind") == "word") & F.col("raw").rlike(r"^\p{Ll}{9,}$")
    got = relational_rules.trigger_ranges(_positions(spark, sf_dir), F.col("term").isin("in", "la", "der", "de"), long_word, 1, 2)
    return got.groupBy((F.col("end") - F.col("start")).alias("n")).agg(F.count("*").alias("c"))


@query("select p_partkey, round(((case when p_size % 2 = 0 then 3 else 2 end) * (p_size % 4 + 1) + 0.5 * (p_size % 4) + p_retailprice / 1000 - 0.25 * (greatest(p_size % 3, 1) - 1)) * 1e6) / 1e6 score from part")
def span_scores(spark, sf_dir):
    """The score formula over the rows of parts."""
    p = table(spark, sf_dir, "part")
    origin = F.when(F.col("p_size") % 2 == 0, 3.0).otherwise(2.0)
    return p.select("p_partkey", relational_rules.score(origin, F.col("p_size") % 4 + 1, F.col("p_retailprice") / 1000, F.col("p_size") % 3).alias("score"))


_CANDIDATES = [("a", 0, 2, "a", 5.0), ("a", 0, 1, "b", 3.0), ("a", 1, 2, "c", 3.0), ("b", 0, 2, "a", 4.0), ("b", 1, 3, "b", 3.0), ("c", 0, 1, "a", 0.0), ("c", 1, 2, "b", -1.0), ("d", 0, 1, "surname", 3.0), ("d", 0, 1, "patronymic", 3.0), ("e", 0, 1, "x", 1.0), ("e", 1, 2, "y", 1.5), ("e", 2, 3, "z", 1.0)]


@golden("case_id, start, stop, type", lambda: [("a", 0, 1, "b"), ("a", 1, 2, "c"), ("b", 0, 2, "a"), ("d", 0, 1, "patronymic"), ("e", 0, 1, "x"), ("e", 1, 2, "y"), ("e", 2, 3, "z")])
def resolve_golden(spark, sf_dir):
    df = prepare(spark).createDataFrame(_CANDIDATES, "case_id string, start int, end int, type string, score double")
    return relational_rules.resolve_flat(df, "case_id").select("case_id", "start", F.col("end").alias("stop"), "type")


@golden("value", lambda: [('{"doc":"lake","start":5,"end":25,"rune_start":3,"rune_end":14,"type":"lake","surface":"оз. Налимье","normal":["Налимье"],"refs":["w:20","w:21"],"attrs":{},"flags":["ambiguous","abbrev"],"score":8.25,"alternatives":[]}',)])
def span_jsonl(spark, sf_dir):
    """One document's spans as JSON lines, without evidence."""
    got = golden_results(prepare(spark)).where("doc_id = 'lake'")
    line = ner.span_json(got)
    return line.select(F.regexp_replace("value", ',"evidence":\\[[^]]*\\]', "").alias("value"))


@query("""with d(ord, name, kind, body) as (values (0, 'base.builtin', 'base', 'a' || chr(9) || 'b' || chr(9) || 'c' || chr(10)), (1, 'x.own', 'x', ''))
    select 'on' state, sha256(string_agg(name || chr(9) || kind || chr(9) || sha256(body) || chr(10), '' order by ord)) v from d union all select 'off', sha256(name || chr(9) || kind || chr(9) || sha256(body) || chr(10)) from d where ord = 0""")
def dictionary_version(spark, sf_dir):
    c = dictionaries.Catalog.open(prepare(spark), base=[("a", "b", "c")], builtins={"x.own": []}, kinds=["x"])
    return spark.createDataFrame([("on", c.version()), ("off", c.set_enabled("x.own", False).version())], "state string, v string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: entity spans over all documents."""
    return entity_spans_documents(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
