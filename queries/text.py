"""Text columns."""

from __future__ import annotations

from burnish.operators.text import term_weights, text_features
from queries.registry import query, r, rounded, table, view

# A short stop list of the languages in the table, given to both sides.
STOP_WORDS = [
    "and", "are", "as", "at", "by", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with",
    "der", "die", "das", "und", "de", "la", "le", "les", "et", "el", "los", "que", "en",
]
TERMS = 50


def processed(method: str, source: str = "documents", columns: tuple[str, ...] = ("doc_id", "text"), column: str = "text"):
    def run(spark, sf_dir):
        df = view(spark, sf_dir, source) if source == "part_tags" else table(spark, sf_dir, source)
        return text_features(df.select(*columns), {column: method}).df

    return run


query(
    "x1_length_and_words",
    r"""select doc_id, length(text)::int as text_length, len(regexp_extract_all(text, '\S+'))::int as text_word_count
    from documents""",
)(processed("length_and_words"))
query("x2_count_delimiter", "select p_partkey, len(string_split(tags, '|'))::int as tags_count from $part_tags")(
    processed("count_delimiter:|", "part_tags", ("p_partkey", "tags"), "tags")
)

STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
COUNTED = rf"""tokens as (select doc_id, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]{{2,}})')) as term from documents),
    words as (select * from tokens where term not in ({STOP_LIST})),
    top as (select term from words group by term order by count(*) desc, term limit {TERMS}),
    tf as (select doc_id, term, count(*) as n from words where term in (select term from top) group by doc_id, term)"""


@query(
    "x3_tfidf",
    f"""with {COUNTED},
    idf as (select term, ln((1.0::double + (select count(*) from documents)) / (1 + count(*))) + 1 as w from tf group by term),
    weighted as (select doc_id, term, n * w as x from tf join idf using (term)),
    lengths as (select doc_id, sqrt(sum(x * x)) as len from weighted group by doc_id)
    select doc_id, term, {r("(x / len)")} as weight from weighted join lengths using (doc_id)""",
)
def tfidf(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return rounded(term_weights(documents, "text", TERMS, ["doc_id"], True, STOP_WORDS), ["weight"])


@query("x9_countvec", f"with {COUNTED} select doc_id, term, n as weight from tf")
def countvec(spark, sf_dir):
    return term_weights(table(spark, sf_dir, "documents"), "text", TERMS, ["doc_id"], False, STOP_WORDS)


@query(
    "x4_contains",
    "select doc_id, text, coalesce(regexp_matches(text, '(?i)the')::int, 0) as text_has_the from documents",
)
def contains(spark, sf_dir):
    return processed("contains:the")(spark, sf_dir)


@query(
    "x5_extract_numbers",
    """select c_custkey, try_cast(nullif(regexp_extract(acct_text, '[0-9.]+'), '') as double) as acct_text_number
    from $customer_dirty""",
)
def extract_numbers(spark, sf_dir):
    dirty = view(spark, sf_dir, "customer_dirty").select("c_custkey", "acct_text")
    return text_features(dirty, {"acct_text": "extract_numbers"}).df


query(
    "x6_clean_and_keep",
    r"""select doc_id, regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^a-z0-9\s]', '', 'g') as text
    from documents""",
)(processed("clean_and_keep"))
query(
    "x7_hash",
    "select page_id, ('0x' || substr(md5(url), 1, 8))::bigint % 32 as url_hash from pages",
)(processed("hash:32", "pages", ("page_id", "url"), "url"))
query("x8_drop", "select doc_id, lang from documents")(processed("drop", columns=("doc_id", "lang", "text")))
