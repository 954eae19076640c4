"""Queries of the text operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.llm import (ann, chat, collocations, decontam, exact_dedup, langid, licenses, pieces, pii, prefix_trie, quality, sharding,
                          simhash)
from shopcast.llm.common import held_out, table

SHARDS = 40
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_file() -> str:
    """Path of the SentencePiece model: SHOPCAST_PIECES, or the installed public one."""
    given = os.environ.get("SHOPCAST_PIECES")
    if given:
        return given
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``key``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select -1L conv_id, t.turn, t.role, :text text from values (0L, 'user'), (1L, 'assistant') t(turn, role)",
                      {"text": PROBE})
    return chat.digests(chat.format_chats(chat.records_of(rows.unionByName(probe))))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every 20th id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.identify(F.col("text"), model).alias("f"))
    return found.select("doc_id", "held_out", "f.lang_pred", "f.score", "f.margin", "f.rejected")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_file())
    back = pieces.decode(F.col("ids"), tokenizer_file())
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids",
                        (back == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    found_in = decontam.profiles(table(spark, sf_dir, "benchmark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = docs.select("doc_id", F.explode(decontam.contamination(F.col("text"), found_in)).alias("f"))
    return hits.select("doc_id", "f.item_id", "f.edits", "f.shared")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts, for every document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_sequences(rows)))


QUERIES = {f.__name__: f for f in (op1_quality, op2_sharding, op3_chat, op4_neighbours, op5_language, op6_pieces, op7_pii,
                                   op8_simhash, op9_decontamination, op10_licenses, op11_exact_dedup, op12_collocations,
                                   op13_prefix_trie)}


#: crc_table(t): the 256 steps of CRC-32; needs ``with recursive``.
_CRC_TABLE = """crc_step(i, k, c) as (select i, 0, i::bigint from range(256) r(i) union all
  select i, k + 1, case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end from crc_step where k < 8),
crc_table as (select list(c order by i) as t from crc_step where k = 8)"""


def _crc(b: str) -> str:
    """CRC-32 of a list of byte values, with ``t`` from crc_table in scope."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {b}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))"


def _sharding_sql() -> str:
    leaves = [(n, region, rack, s) for n in (SHARDS, SHARDS + 1) for region, racks in sharding.numbered_tree(n).items()
              for rack, shards in racks.items() for s in shards]
    values = ", ".join(f"({n}, '{region}', '{region}/{rack}', '{region}/{rack}/{s}', {s})" for n, region, rack, s in leaves)

    def draw(name: str, weight: str) -> str:
        return (f"-ln((cast('0x' || substr(md5({name} || '|' || coalesce(cast(k.doc_id as varchar), '')), 1, 13) as bigint) + 0.5)"
                f" / 4503599627370496.0) / {weight}")
    return f"""
with recursive tree(n, region, rack, leaf, shard) as (values {values}),
keys as (select distinct doc_id from documents),
regions as (select n, region, count(*) w from tree group by all),
racks as (select n, region, rack, count(*) w from tree group by all),
in_region as (select k.doc_id, n, arg_min(region, {draw('region', 'w')}) region from keys k, regions group by k.doc_id, n),
in_rack as (select k.doc_id, k.n, arg_min(r.rack, {draw('r.rack', 'r.w')}) rack
            from in_region k join racks r on k.n = r.n and k.region = r.region group by k.doc_id, k.n),
in_shard as (select k.doc_id, k.n, arg_min(t.shard, {draw('t.leaf', '1')}) shard
             from in_rack k join tree t on k.n = t.n and k.rack = t.rack group by k.doc_id, k.n),
{_CRC_TABLE},
bytes as (select doc_id, coalesce(text, '') as text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                 lambda x: ('0x' || x)::bigint) as b from documents),
sized as (select doc_id, strlen(text)::bigint + {sharding.HEADER_BYTES} as size,
                 {_crc("b")} as text_crc32
          from bytes, crc_table)
select d.doc_id, size, text_crc32::bigint as text_crc32, 'key' as law, a.shard::int as shard, b.shard::int as grown_shard,
       row_number() over (partition by a.shard order by d.doc_id, text_crc32, size) - 1 as slot
from sized d join in_shard a on a.doc_id is not distinct from d.doc_id and a.n = {SHARDS}
join in_shard b on b.doc_id is not distinct from d.doc_id and b.n = {SHARDS + 1}"""


def _licenses_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"
    whole, sentences = licenses.whole_sentences(), licenses.known_sentences()
    width = licenses.opener_width(sentences)
    known = ", ".join(f"({quoted(s)}, {quoted(i)}, {len(s.split())}, {quoted(' '.join(s.split()[:width]))}, {s in whole})"
                      for s, i in sentences.items())
    steps, last = [], "r0"
    for n, (name, seq) in enumerate(licenses.RULES, 1):
        part = quoted("".join(f"<{x}>" for x in seq))
        steps.append(f"r{n} as (select rid, doc_id, sentences, replace(rest, {part}, '') as rest, "
                     f"case when contains(rest, {part}) then list_append(lic, '{name}') else lic end as lic from {last})")
        last = f"r{n}"
    tag, member = licenses.SPDX_TAG, r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
    members = rf"^[ \t(]*{member}(?:[ \t)]+(?:or|and|with)[ \t(]+{member})*"
    opener = " || ' ' || ".join(["w", *(f"lead(w, {k}) over ahead" for k in range(1, width))])
    return f"""
with known(s, i, n, opener, alone) as (values {known}),
docs as (select row_number() over () as rid, doc_id, string_split(lower(coalesce(text, '')), '{tag}') as parts from documents),
tagged as (select rid, doc_id, parts[1] || coalesce(array_to_string(list_transform(parts[2:], lambda x: chr(10) || '{tag}' ||
             regexp_replace(regexp_extract(x, '{members}'), '[ \\t)]+(or|and|with)[ \\t(]+', chr(10) || '{tag} ', 'g')
             || x[length(regexp_extract(x, '{members}')) + 1:]), ''), '') as text from docs),
plain as (select rid, doc_id, chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '([0-9])\\+([^a-z0-9]|$)', '\\1 or later\\2', 'g'),
            '[.!?;:]([ \\t\\n\\x0b\\f\\r*#/])|\\*/|-->', chr(10) || '\\1', 'g'), '[^a-z0-9\\n]+', ' ', 'g') || chr(10) as text from tagged),
words as (select rid, doc_id, string_split(trim(regexp_replace(text, '(?: ?\\n)+ ?', ' |', 'g')), ' ') as w from plain),
place as (select rid, unnest(w) as x, ltrim(x, '|') as w, generate_subscripts(w, 1) as p from words),
opened as (select rid, p, {opener} as opener from place window ahead as (partition by rid order by p)),
tried as (select o.rid, o.p, k.*, d.w from opened o join known k on k.opener = o.opener join words d on d.rid = o.rid),
hit as (select rid, p, p + n as stop, i from tried
        where replace(array_to_string(w[p:p + n - 1], ' '), '|', '') = s and (not alone or (w[p][1] = '|' and w[p + n][1] = '|'))
        qualify row_number() over (partition by rid, p order by n desc) = 1),
ids as (select * from hit qualify stop > coalesce(max(stop) over (partition by rid order by p rows between unbounded preceding and 1 preceding), 0)),
seq as (select rid, string_agg(i, ',' order by p) as sentences, string_agg('<' || i || '>', '' order by p) as whole from ids group by rid),
r0 as (select d.rid, d.doc_id, coalesce(sentences, '') as sentences, coalesce(whole, '') as rest, []::varchar[] as lic
       from words d left join seq s on s.rid = d.rid),
{', '.join(steps)}
select doc_id, sentences, coalesce(array_to_string(list_sort(list_distinct(lic)), ','), '') as licenses,
       translate(replace(rest, '><', ','), '<>', '') as unmatched from {last}"""


_ESC = r"regexp_replace(replace({0}, '\', '\z'), '([<\[])(/?)(s>|INST\])', '\1\\c\2\3', 'g')"
_CHAT_SQL = f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
said as (select *, {_ESC.format('text')} as body, replace({_ESC.format('role')}, chr(10), '\\n') as name from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(case when role = 'assistant' then length(body) + 4 else length(name) + length(body) + 16 end))::bigint as formatted_chars,
       'messages_text' as layout
from rows2 group by conv_id""".replace("rows2", "said")

_DEDUP_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""

_COLLOCATIONS_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (select lang, w[i:i + k - 1] as p from starts, range(1, 5) s(k) where i + k - 1 <= len(w)),
f as (select lang, p, count(*) as n from grams group by all),
candidates as (select lang, p, n as a from f where len(p) > 1 and n >= 30),
cuts as (select c.lang, c.p, c.a, k, l.n as l, r.n as r, (2000000::hugeint * c.a // (l.n::hugeint + r.n)) as score
         from (select *, unnest(range(1, len(p))) as k from candidates) c
         join f l on l.lang = c.lang and l.p = c.p[1:c.k] join f r on r.lang = c.lang and r.p = c.p[c.k + 1:]),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (select lang, p[i:i + k - 1] as p, max(a) as longer
           from (select *, unnest(range(1, len(p) + 1)) as i from candidates), range(2, 4) s(k)
           where i + k - 1 <= len(p) and k < len(p) group by all),
kept as (select best.* from best left join inside using (lang, p) where longer is null or 100::hugeint * longer < 80::hugeint * a),
total as (select lang, count(*) as n from starts group by lang),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank,
                  array_to_string(p, ' ') as phrase, a, l, r, score::bigint as score from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000"""

_TRIE_SQL = f"""
with recursive {_CRC_TABLE},
own as (select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                             order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
        from conversations where conv_id is not null group by conv_id),
headed as (select conv_id, turns, ({_crc("list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)")} % 6)::bigint as h
           from own, crc_table),
built as (select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns
          from headed c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
members as (select conv_id, turns[1:d] as p, d, len(turns) = d as ends from (select *, unnest(range(0, len(turns) + 1)) as d from built)),
nodes as (select p, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from members group by p, d),
linked as (select n.*, up.conv_id as parent_conv_id, up.p as parent
           from nodes n left join nodes up on up.depth = n.depth - 1 and up.p = n.p[1:n.depth - 1]),
children as (select parent as p, count(*) as n_children from linked where depth > 0 group by all),
full_nodes as (select l.*, coalesce(n_children, 0) as n_children from linked l left join children c on c.p = l.p),
sums as (select p[1:d] as p, count(*) filter (n_children = 0) as n_leaves,
                sum(case when depth > 0 then (n_convs - 1) * length(p[depth].text) else 0 end)::bigint as saved_tokens
         from (select *, unnest(range(0, depth + 1)) as d from full_nodes) group by 1)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from full_nodes join sums using (p)"""

ORACLE_SQL = {"op2_sharding": _sharding_sql(), "op3_chat": _CHAT_SQL, "op10_licenses": _licenses_sql(),
              "op11_exact_dedup": _DEDUP_SQL, "op12_collocations": _COLLOCATIONS_SQL, "op13_prefix_trie": _TRIE_SQL}
