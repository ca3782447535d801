"""TXT* and EXT*: tags, tokens, TF-IDF and page extraction on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import wordlists as W
from orrery.operators import tags as TG
from orrery.operators import text as TX
from orrery.plans.registry import query
from orrery.plans.tables import in_order
from orrery.session import cut_lineage
from orrery.sources import html as H

# -- tags --------------------------------------------------------------------------------------------------------------
# Keywords of a document: its words, each pair of neighbours as a phrase, and a few hand-written tags by id.
HAND_TAGS = [
    "and 119 more", "Submillimetre", "Surveys: large", "NGC 2293", "X-rays: general", "radio continuum", "12345",
    "Galaxies: individual (M31)", "stars, binary", "dust", "exoplanets", "Zodiacal  dust", "sn 1987a", "abc1",
]


def _keywords(t):
    words = F.split("text", " ")
    following = F.slice(words, F.lit(2), F.size(words))
    pairs = F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))))
    hand = F.array(*[F.lit(h) for h in HAND_TAGS])
    return t.documents.select("doc_id", F.concat(words, pairs, F.slice(hand, (F.col("doc_id") % 7 + 1).cast("int"), 8)).alias("keywords"))


_SQL_KEYWORDS = (
    "(with w as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from (select doc_id, string_split(text, ' ') as words from documents)) "
    "select distinct doc_id, raw from (select doc_id, w as raw from w union all "
    "select doc_id, w || ' ' || coalesce(lead(w) over (partition by doc_id order by i), '') from w union all "
    "select doc_id, unnest(list_slice(["
    + ", ".join(f"'{h}'" for h in HAND_TAGS)
    + "], (doc_id % 7) + 1, (doc_id % 7) + 8)) from documents))"
)


def _sql_clean_tags() -> str:
    q = lambda s: s.replace("'", "''")
    strip = "regexp_replace(trim({x}, ' '), ' +', ' ', 'g')"
    body = (
        "select raw, " + strip.replace("{x}", r"regexp_replace(lower(trim(raw, ' ')), '[[:punct:]]', ' ', 'g')") + " as x "
        f"from (select distinct raw from {_SQL_KEYWORDS}) where not contains(raw, ',')"
    )
    body = (
        f"select raw, trim(split_part(x, ' individual ', 1), ' ') as x from ({body}) where not regexp_full_match(x, '[0-9]+') "
        "and not contains(x, 'ngc ') and not contains(x, 'sn ') and not contains(x, 'ugc ')"
    )
    body = (
        "select raw, " + strip.replace("{x}", "regexp_replace(x, '[0-9]', '', 'g')") + f" as x from ({body}) "
        "where not (contains(x, 'and') and contains(x, 'more'))"
    )
    chain = "x"
    rules = TG.TagRules()
    for old, new in rules.contains:
        chain = f"replace({chain}, '{q(old)}', '{q(new)}')"
    body = f"select raw, {chain} as x from ({body}) where length(x) > 3"
    prefixes = ", ".join(f"'{q(old)}|{q(new)}'" for old, new in rules.prefixes)
    step = "case when starts_with(x, split_part(r, '|', 1)) then split_part(r, '|', 2) else x end"
    body = f"select raw, list_reduce(list_prepend(x, [{prefixes}]), lambda x, r: {step}) as x from ({body})"
    ignore = ", ".join(f"'{q(i)}'" for i in W.TAG_IGNORE)
    return f"(select raw, x as tag from ({body}) where x not in ({ignore}))"


SQL_CLEAN = _sql_clean_tags()


@query(
    "txt01_clean_tags",
    sql=f"""select doc_id, count(distinct tag) as tags, md5(string_agg(distinct tag, '|' order by tag)) as digest
 from {_SQL_KEYWORDS} k join {SQL_CLEAN} c using (raw) group by doc_id""",
)
def txt01(t):
    cleaned = _keywords(t).select("doc_id", TG.clean_tags(F.col("keywords")).alias("tags"))
    return cleaned.select("doc_id", F.size("tags").cast("bigint").alias("tags"), F.md5(F.array_join("tags", "|")).alias("digest"))


@query("txt02_tag_vocabulary", sql=f"select distinct tag from {SQL_CLEAN}")
def txt02(t):
    return TG.vocabulary(_keywords(t), "keywords")


@query(
    "txt03_papers_with_tag",
    sql=f"select distinct doc_id from {_SQL_KEYWORDS} join {SQL_CLEAN} using (raw) where contains(tag, 'planet') or contains(tag, 'the the')",
)
def txt03(t):
    return TG.ids_with_tag(_keywords(t), "doc_id", "keywords", ["PLANET", "the the"])


# -- tokens ------------------------------------------------------------------------------------------------------------
_URL = r"http[s+]?:[s+]?//[!$-_a-z]+"
_RAW_URLS = f"regexp_extract_all(html || ' ' || url || ', see ' || url || '#x', '{_URL}')"


@query("txt04_find_urls", sql=f"select page_id, u as url, count(*) as n from (select page_id, unnest({_RAW_URLS}) as u from pages) group by all")
def txt04(t):
    text = F.concat("html", F.lit(" "), "url", F.lit(", see "), "url", F.lit("#x"))
    return t.pages.select("page_id", F.explode(TX.urls(text)).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


def _sql_hidden(col: str) -> str:
    return f"list_reduce(regexp_extract_all({col}, '{_URL}'), lambda acc, u: replace(acc, u, 'placeholderurl'), {col})"


@query(
    "txt05_hide_urls",
    sql=f"select page_id, length(x) as n, md5(x) as digest from (select page_id, {_sql_hidden('html')} as x from pages)",
)
def txt05(t):
    x = TX.hide_urls(F.col("html"))
    return t.pages.select("page_id", F.length(x).cast("bigint").alias("n"), F.md5(x).alias("digest"))


_WHITE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}]+"


def _sql_tokens(text: str, source: str) -> str:
    split = "w"
    for whole, cut in W.SPLIT_WORDS.items():
        split = f"case when lower(w) = '{whole}' then substr(w, 1, {cut}) || ' ' || substr(w, {cut + 1}) else {split} end"
    return f"""(select doc_id, unnest(string_split({split}, ' ')) as token from (
 select doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace({_sql_hidden(text)}, '[[:punct:]]', ' ', 'g'), '[0-9]', ' ', 'g'), '{_WHITE}')) as w
 from {source}) where w <> '')"""


@query("txt06_tokens", sql=f"select doc_id, token, count(*) as n from {_sql_tokens('text', 'documents')} group by all")
def txt06(t):
    return t.documents.select("doc_id", F.explode(TX.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


_SQL_STOP = "(" + ", ".join(f"'{w}'" for w in W.ENGLISH_STOP_WORDS) + ")"


@query(
    "txt07_stop_words",
    sql=f"select doc_id, count(*) as kept from {_sql_tokens('text', 'documents')} where token not in {_SQL_STOP} group by doc_id",
)
def txt07(t):
    kept = F.size(TX.without_stop_words(TX.tokens(F.col("text")))).cast("bigint")
    return t.documents.select("doc_id", kept.alias("kept")).filter("kept > 0")


_SQL_ROWS = f"(select * from {_sql_tokens('lower_text', '(select doc_id, lower(text) as lower_text, lang from documents)')} where token not in {_SQL_STOP})"
# Lemma table of the checks: every token that ends in 'ing' or 'ed' loses the ending; 'eaux' words become upper case.
_SQL_LEMMAS = f"""(select distinct token, case when ends_with(token, 'ing') then token[:-4] when ends_with(token, 'ed') then token[:-3] else upper(token) end as lemma
 from {_SQL_ROWS} where (ends_with(token, 'ing') and length(token) > 3) or (ends_with(token, 'ed') and length(token) > 2) or ends_with(token, 'eaux'))"""


def _lemmas(rows):
    ending = F.length("token")
    cut = (
        F.when(F.endswith("token", F.lit("ing")) & (ending > 3), F.expr("left(token, length(token) - 3)"))
        .when(F.endswith("token", F.lit("ed")) & (ending > 2), F.expr("left(token, length(token) - 2)"))
        .when(F.endswith("token", F.lit("eaux")), F.upper("token"))
    )
    return rows.select("token").distinct().withColumn("lemma", cut).filter("lemma is not null")


@query(
    "txt08_lemmas",
    sql=f"select doc_id, coalesce(lemma, token) as token, count(*) as n from {_SQL_ROWS} left join {_SQL_LEMMAS} using (token) group by all",
)
def txt08(t):
    rows = TX.token_rows(t.documents, "doc_id", "text")
    return TX.token_counts(TX.lemmatise(rows, _lemmas(rows)), "doc_id")


@query(
    "txt09_token_counts",
    sql=f"""select doc_id, token, count(*) as n from {_SQL_ROWS} where doc_id % 2 = 1
 and token in (select token from {_SQL_ROWS} where doc_id % 2 = 0) group by all""",
)
def txt09(t):
    rows = TX.token_rows(t.documents, "doc_id", "text")
    fitted = rows.filter("doc_id % 2 = 0").select("token").distinct()
    return TX.token_counts(rows.filter("doc_id % 2 = 1"), "doc_id", fitted)


@query(
    "txt10_tf_idf",
    sql=f"""with c as (select doc_id, token, count(*) as n from {_SQL_ROWS} group by all),
 f as (select token, ln((select count(*) from documents) / count(*)) + 1 as idf from c group by token),
 w as (select doc_id, token, n * idf as v from c join f using (token)),
 d as (select doc_id, sqrt(sum(v * v)) as len from w group by doc_id)
 select doc_id, token, round(v / len, 6) as weight from w join d using (doc_id)""",
)
def txt10(t):
    counts = cut_lineage(TX.token_counts(TX.token_rows(t.documents, "doc_id", "text"), "doc_id"))
    idf = TX.inverse_frequencies(counts, t.documents.count())
    return TX.tf_idf(counts, "doc_id", idf).withColumn("weight", F.round("weight", 6))


@query("txt11_text_features")
def txt11(t):
    _, scores = TX.text_features(t.documents, "doc_id", "text", k=20)
    return scores


VERBS = ["the", "of", "le", "der", "and"]


@query(
    "txt12_starting_verb",
    sql=r"""select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)),
 lambda s: lower(regexp_extract(s, '^[\s[:punct:]]*(\p{L}+)', 1)) in ('the', 'of', 'le', 'der', 'and') or regexp_extract(s, '^[\s[:punct:]]*(\p{L}+)', 1) = 'RT')) > 0 as starts
 from documents""",
)
def txt12(t):
    return t.documents.select("doc_id", TX.starts_with_verb(F.col("text"), VERBS).alias("starts"))


# -- pages -------------------------------------------------------------------------------------------------------------
# Table pages of the checks: per part one page with p_size % 14 rows of nine cells; some parts have no table.
def _table_pages(t):
    row = lambda i: F.concat(
        F.lit("<tr class='r'><td> <b>ref"), i.cast("string"), F.lit("</b></td><td>"),
        F.when((i + F.col("p_partkey")) % 4 == 0, "").otherwise(((i * 7 + F.col("p_partkey")) % 100).cast("string")),
        F.lit("</td><td>"), F.col("p_brand"), F.lit("</td><td></td><td></td><td></td><td></td><td></td>\n<td>"), F.col("p_name"), F.lit(" </td></tr>\n"),
    )
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 14), row), "")
    table = F.concat(F.lit('<table><tbody class="datatable sortable">'), rows, F.lit("</tbody></table>"))
    html = F.concat(F.lit("<html><p>x</p>"), F.when(F.col("p_partkey") % 6 != 0, table).otherwise(F.lit("")), F.lit("</html>"))
    return in_order(t.part, "p_partkey").select("p_partkey", html.alias("html"))


# The twin states the cells directly instead of parsing them again.
_SQL_CELLS = """(select p_partkey, i::integer as row_no, 'ref' || i as c0, case when (i + p_partkey) % 4 = 0 then '' else ((i * 7 + p_partkey) % 100)::varchar end as c1,
 p_brand as c2, p_name as c8 from (select *, unnest(range(0, (p_size % 14) + 1)) as i from part where p_partkey % 6 <> 0))"""


@query(
    "ext01_table_cells",
    sql=f"select p_partkey, row_no, c0 || '|' || c1 || '|' || c2 || '||||||' || c8 as cells from {_SQL_CELLS} where row_no < 10",
)
def ext01(t):
    rows = H.table_rows(_table_pages(t), "p_partkey", limit=10)
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query(
    "ext02_bibliography",
    sql=f"select p_partkey, c0 as refcode, try_cast(nullif(c1, '') as integer) as score, c2 as relevance_code, c8 as title from {_SQL_CELLS}",
)
def ext02(t):
    # The parts are in order before their pages are parsed: ordering the rows would parse every page twice, to sample and to sort.
    rows = H.bibliography(_table_pages(t), "p_partkey").drop("row_no")
    return rows.sortWithinPartitions("p_partkey", F.col("score").desc_nulls_last())


@query(
    "ext03_links",
    sql="""select distinct page_id, link from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) as link from pages) where contains(link, 'th')""",
)
def ext03(t):
    return H.links_containing(t.pages, "page_id", "th")


_SQL_ABSTRACT = """(select page_id, case when page_id % 7 = 0 then html else '<h2 class="x s-abstract-title"> <i>' || url || '</i>
 </h2><div class="s-abstract-text">Abstract  ' || length(html)::varchar || ' Abstract of ' || url || ' </div>' || html end as html, url from pages)"""


def _abstract_pages(t):
    head = F.concat(
        F.lit('<h2 class="x s-abstract-title"> <i>'), "url", F.lit('</i>\n </h2><div class="s-abstract-text">Abstract  '),
        F.length("html").cast("string"), F.lit(" Abstract of "), "url", F.lit(" </div>"), "html",
    )
    return t.pages.select("page_id", "url", F.when(F.col("page_id") % 7 == 0, F.col("html")).otherwise(head).alias("html"))


@query(
    "ext04_title_and_abstract",
    sql="select page_id, url as title, length(html)::varchar || '  of ' || url as description from pages where page_id % 7 <> 0",
)
def ext04(t):
    return H.title_and_abstract(_abstract_pages(t), "page_id")


@query(
    "ext05_keywords",
    sql=r"""select page_id, array_to_string(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<ul>(.*?)</ul>', 1), '(?is)<li[^>]*>(.*?)</li>', 1),
 lambda x: trim(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), ';', ''))), '|') as keywords from pages""",
)
def ext05(t):
    listed = F.replace("html", F.lit("<ul>"), F.lit('<ul class="a list-inline">'))
    listed = F.replace(listed, F.lit("</li>"), F.lit(";</li>"))
    return t.pages.select("page_id", F.array_join(H.keyword_list(listed), "|").alias("keywords"))


@query(
    "ext06_paper_link",
    sql="""select page_id, case when page_id % 3 = 0 then 'https://arxiv.org/abs/astro/' || page_id::varchar
 else 'https://ui.adsabs.harvard.edu/abs/' || page_id::varchar || 'A&A/abstract' end as link from pages""",
)
def ext06(t):
    key = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a class="y" href="/link/arXiv:'), key, F.lit('">\n arXiv:astro/'), key, F.lit(" </a>")))
    block = F.concat(F.lit('<dl class="s-abstract-dl-horizontal"><a href="/doi">doi</a>'), F.coalesce(link, F.lit("")), F.lit("</dl>"), F.col("html"))
    return t.pages.select("page_id", H.paper_link(block, F.concat(key, F.lit("A&A"))).alias("link"))


@query(
    "ext07_keyed_numbers",
    sql="""select vec_id, round(embedding[1]::double, 6) as redshift, round(embedding[2]::double, 6) as flux_up, round(embedding[3]::double, 6) as flux_low,
 null::double as flux_b from embeddings""",
)
def ext07(t):
    part = lambda i: F.get("embedding", F.lit(i)).cast("double").cast("string")
    text = F.concat(
        F.lit("C.D.S.  -  page\nRedshift:  "), part(0), F.lit(" ~ [0.1] C\nFlux U  :   "), part(1), F.lit(" [~] D 2002\nFlux u : "), part(2),
        F.lit(" E\nFlux B : ~ \nFlux U : 99"),
    )
    cols = H.keyed_numbers(text, ["Redshift", "Flux U", "Flux u", "Flux B"])
    names = ["redshift", "flux_up", "flux_low", "flux_b"]
    return t.embeddings.select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(cols, names)])


@query("ext08_labelled_link", sql="select page_id, case when page_id % 2 = 0 then '20' || page_id::varchar || 'ApJ' end as refcode from pages")
def ext08(t):
    label = F.when(F.col("page_id") % 2 == 0, " View the reference in ADS ").otherwise("View the reference in ADS!")
    anchor = F.concat(F.col("html"), F.lit('<a class="z" href="http://ads/abs/20'), F.col("page_id").cast("string"), F.lit('ApJ">'), label, F.lit("</a>"))
    return t.pages.select("page_id", H.labelled_link_id(anchor).alias("refcode"))
