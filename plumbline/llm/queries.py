"""The registered queries of this subpackage and their SQL counterparts (DuckDB)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import html_crf, quality
from plumbline.llm.common import map_rows, shared_folder, small_batches
from plumbline.llm.decontaminate import find_overlaps
from plumbline.llm.divergence import source_divergence
from plumbline.llm.line_dedup import drop_repeated_lines
from plumbline.llm.packing import pack_documents
from plumbline.llm.prefix_trie import ends_digest, number_turns, prefix_trie, splice_heads
from plumbline.llm.secrets import scan_secrets
from plumbline.llm.simhash import simhash_components
from plumbline.llm.suffix_dedup import drop_repeated_strings, sha256
from plumbline.llm.token_codes import read_tokens, write_tokens
from plumbline.llm.topk import top_k
from plumbline.llm.warc import archive_folder, read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# SHA-1 in base32: the 160 bits of the hexadecimal digits in groups of five.
BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + cast(list_sum(list_transform(range(0, 5), lambda j: cast(substr(bits, cast(i * 5 + j + 1 as bigint), 1) as bigint) * cast(pow(2, 4 - j) as bigint))) as bigint), 1)), '')"""


@register("op4_warc", f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(encode(coalesce(html, ''))) as h from pages),
q as (select *, max(page_id) over (partition by h) as last,
  array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
    1 + 4 * (instr('0123456789abcdef', substr(h, cast(i as bigint), 1)) - 1), 4)), '') as bits from p)
select page_id, payload_bytes, {BASE32} as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from q
""")
def op4(spark, sf):
    """Every page written to WARC archives and read back."""
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    archives = write_warc(pages, archive_folder(spark))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings),
pairs as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
""")
def op5(spark, sf):
    """The ten best of all vectors for each hundredth."""
    return top_k(table(spark, sf, "embeddings", "vec_id", "embedding"))


@register("op6_best_fit_packing")
def op6(spark, sf):
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op1_html_crf")
def op1(spark, sf):
    """The main text of all pages, by a model trained on a sample of them."""
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return html_crf.extract_main_text(pages, html_crf.train(pages)).drop("html")


@register("op2_suffix_dedup")
def op2(spark, sf):
    """Every byte of all documents that a repeated string of 400 bytes covers, removed."""
    done = drop_repeated_strings(table(spark, sf, "documents", "doc_id", "text"))
    return map_rows(done.drop("text"), "kept_sha256 string", sha256, drop=("kept",))


@register("op3_simhash")
def op3(spark, sf):
    """Near-duplicates of all documents by 64-bit fingerprints."""
    return simhash_components(table(spark, sf, "documents", "doc_id", "text"))


def sha256_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` replaced by its hash; null counts as empty."""
    return df.select("*", F.sha2(F.encode(F.coalesce(F.col(column), F.lit("")), "utf-8"), 256).alias(name)).drop(column)


@register("op7_line_dedup", f"""
with lines as (
  select doc_id, pos, line, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
common as (select k, max(doc_id) as keep from lines where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select l.*, c.keep is not null and c.keep <> l.doc_id as gone from lines l left join common c on l.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op7(spark, sf):
    """Lines shared by five documents or more, dropped from all but the last."""
    kept = drop_repeated_lines(table(spark, sf, "documents", "doc_id", "text"))
    return sha256_of(kept, "text", "kept_sha256")


@register("op8_quality")
def op8(spark, sf):
    """Quality and toxicity of all documents from their texts and their sites."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    model = quality.train(docs, table(spark, sf, "labels", "doc_id", "quality", "toxic"))
    return quality.classify(docs, model).drop("text", "lang")


@register("op9_secrets")
def op9(spark, sf):
    """Secrets and linked credential parts of all documents."""
    return scan_secrets(table(spark, sf, "documents", "doc_id", "text")).drop("text")


WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op10_decontamination", f"""
with d as (select doc_id, {WORDS} as w from documents),
i as (select item_id, {WORDS} as w from benchmark),
need as (select distinct least(len(w), 10) as size from i where len(w) > 0),
windows as (select distinct item_id, least(len(w), 10) as size,
    array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') as x
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)),
grams as (select doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') as x
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from d, need where len(w) >= size)),
found as (select g.doc_id, g.p, g.size, n.item_id from grams g join windows n on g.x = n.x and g.size = n.size),
hits as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + size)) as q from found) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
  sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join hits h on d.doc_id = h.doc_id left join items t on d.doc_id = t.doc_id
""")
def op10(spark, sf):
    """Benchmark passages in all documents."""
    found = find_overlaps(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"))

    def digest(b: pa.RecordBatch) -> dict:
        spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        return {
            "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(i) for i in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
            "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
        }

    narrow = found.select("doc_id", "n_words", "spans", "items")
    return map_rows(narrow, "n_hit long, n_items long, items_sha256 string, contaminated boolean", digest, drop=("spans", "items"))


# CRC-32 of the decimal id: a step per bit, the first of each byte takes the byte in.
CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(
    string_split(cast(conv_id as varchar), ''), lambda ch: list_prepend(cast(ord(ch) as bigint), list_transform(range(7), lambda z: cast(0 as bigint)))))),
  lambda c, x: case when xor(c, x) & 1 = 1 then xor(xor(c, x) >> 1, 3988292384) else xor(c, x) >> 1 end))"""


@register("op11_prefix_trie", f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as other, cast({CRC32} % 9 as bigint) as h from (select distinct conv_id from t)),
n as (select c.*, coalesce((select count(*) from t where t.conv_id = c.other and t.pos <= c.h), 0) as m from c),
r as (select n.conv_id, t.pos, role, text from n join t on t.conv_id = n.other and t.pos <= n.h
  union all select n.conv_id, t.pos - n.h + n.m, role, text from n join t on t.conv_id = n.conv_id and t.pos > n.h),
k as (select conv_id, pos, octet_length(encode(text)) as bytes,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by pos)) as node from r),
p as (select conv_id, pos as depth, node, coalesce(lag(node) over (partition by conv_id order by pos), 'root') as parent, bytes from k
  union all select conv_id, 0, 'root', null, 0 from c),
nodes as (select node, min(parent) as parent, min(depth) as depth, min(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs from p group by node),
kids as (select parent as node, count(*) as n from nodes where depth > 0 group by parent),
tree as (select p.node, count(*) filter (where k.n is null) as n_leaves, cast(sum((d.n_convs - 1) * d.bytes) as bigint) as saved
  from nodes d join p on p.conv_id = d.conv_id and p.depth <= d.depth left join kids k on k.node = d.node group by p.node),
ends as (select node, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, arg_max(node, depth) as node from p group by conv_id) group by node)
select v.conv_id, v.depth, u.conv_id as parent_conv_id, v.n_convs, coalesce(k.n, 0) as n_children, t.n_leaves,
  t.saved as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes v join tree t using (node) left join nodes u on v.parent = u.node left join kids k on k.node = v.node left join ends e on e.node = v.node
""")
def op11(spark, sf):
    """The prefix trie of all conversations, each rebuilt from the head of another and its own rest."""
    turns = number_turns(table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    nodes, ends = prefix_trie(*splice_heads(turns))
    done = nodes.join(ends_digest(ends), "node", "left").withColumnRenamed("saved", "saved_tokens")
    nothing = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


TERMS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op12_source_divergence", f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, {TERMS} as w, row_number() over () as row from documents),
tokens as (select lang, source, row, unnest(w) as term from d),
kept as (select lang, term from tokens group by lang, term having count(distinct row) >= 10),
size as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from tokens join kept using (lang, term) group by lang, source, term),
totals as (select g.lang, g.source, coalesce(t.total, 0) as total, coalesce(z.v, 0) as v
  from (select distinct lang, source from d) g left join size z using (lang)
  left join (select lang, source, sum(n) as total from counts group by lang, source) t using (lang, source)),
grid as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
    cast(1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // (t.total + 2 * t.v) as bigint) as p
  from totals t join kept k using (lang) left join counts c using (lang, source, term)),
whole as (select lang, term, cast(1 + (cast(1000000000 as hugeint) * (n + 2)) // (total + 2 * v) as bigint) as q
  from (select lang, term, sum(n) as n from counts group by lang, term)
  join (select lang, sum(total) as total, any_value(v) as v from totals group by lang) using (lang)),
sums as (select a.lang, a.source, b.source as item, cast(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as bigint) as value
  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(s.value, 0) as value
  from totals x join totals y on x.lang = y.lang and x.source <> y.source
  left join sums s on s.lang = x.lang and s.source = x.source and s.item = y.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value
  from grid join whole using (lang, term) where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all
select * from (select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms) where rank <= 10
""")
def op12(spark, sf):
    """How far apart all sources of each language are in their words, and the words typical of each."""
    return source_divergence(table(spark, sf, "documents", "doc_id", "text", "lang", "source"))


@register("op13_token_codes")
def op13(spark, sf):
    """The token ids of all documents, written to directly addressable files and read back."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    files = write_tokens(docs, shared_folder(spark, "codes"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
