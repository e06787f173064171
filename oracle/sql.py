"""DuckDB oracle SQL, one statement per registered query.

Fixture roles are CTEs over the pre-registered base views, written as in
FIXTURES.md. Each query's SQL is independent of the Spark code path: the
oracle uses the plain, dense formulation (window ranks, cross products of
small tables) that is easy to read; Spark uses the scalable one.
"""

from __future__ import annotations

from parlance.plans.answer import BUSY_TEXT

# Patterns in RE2 syntax (the Spark side uses the same sets in Java syntax).
SEG = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"
CHAR = r"(?s)."
TOKEN = r"\p{Han}|[^\p{Han}\P{L}]+|\p{N}+"
PUNCT = r"[!-/:-@\[-`{-~]"

ROLES = {
    "faq": """faq AS (
  select conv_id*16777216+turn ord, text "Text", conv_id "FaqSettingId", "Demand", "Supply"
  from conversations
  join (select conv_id, min(case when role='user' then turn end) du,
               min(case when role='assistant' then turn end) ds
        from conversations group by conv_id) k using(conv_id)
  left join (select conv_id, turn du, text "Demand" from conversations) a using(conv_id, du)
  left join (select conv_id, turn ds, text "Supply" from conversations) b using(conv_id, ds)
  where role='user')""",
    "intent": """intent AS (
  select doc_id ord, text "Text",
         case when doc_id%7=0 then null else cast(doc_id%3 as int) end "Rank",
         lang "IntentionName",
         doc_id % (select count(distinct conv_id) from conversations) "FaqSettingId"
  from documents)""",
    "emo": """emo AS (
  select doc_id ord, text "Question", concat('q', quality, 't', toxic) "EmotionName"
  from documents join labels using(doc_id))""",
    "sent": """sent AS (
  select doc_id ord, text, quality positive from documents join labels using(doc_id))""",
    "questions": """questions AS (
  select conv_id*16777216+turn qid, text,
         case when turn%4=0 then '0.9' end threshold_faq,
         cast(null as varchar) threshold_intent
  from conversations where role='user')""",
    "syn": """syn AS (
  select * from (values (1,10,'le'),(2,10,'the'),(3,20,null),(4,20,'und'),(5,20,'and'),
       (6,30,'la'),(7,30,'le'),(8,40,'of the'),(9,40,'of')) t(ord, "SynonymId", "Text"))""",
    "stop": """stop AS (
  select * from (values ('the'),('and'),('of'),('de'),('la'),('der'),('to'),('in')) t("Text"))""",
    "options": """options AS (
  select * from (values (1,'SimilarityFAQBot','0.6'),(2,'SimilarityIntentionBot','0.8'),(3,'ChatBotKind','1'),
       (4,'4000Faq','1'),(5,'4000Intention','2'),(6,'4000Emo','4'),(7,'SimilarityFAQBot','0.9')) t(ord, "Key", "Value"))""",
    "bot_model": """bot_model AS (
  select * from (values (1,1,'nb'),(2,2,'logreg'),(3,3,'mlp'),(4,4,'rf'),(5,2,'a later name')) t(ord, "Id", "Name"))""",
    "script_map": """script_map AS (
  select * from (values (1,'straße','strasse'),(2,'ß','ss'),(3,'é','e'),(4,'ç','c')) t(ord, src, dst))""",
}

# Derived building blocks: name -> (dependencies, CTE text).
BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, deps: list[str], body: str) -> None:
    BLOCKS[name] = (deps, f"{name} AS (\n{body})")


def with_(*names: str) -> str:
    """WITH clause holding ``names`` and everything they depend on, in order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        if n in BLOCKS:
            for d in BLOCKS[n][0]:
                visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    parts = [ROLES[n] if n in ROLES else BLOCKS[n][1] for n in seen]
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------
block("syn_pairs", ["syn"], """
  select list({'term': s."Text", 'canon': c.first_word} order by s.ord) p
  from syn s join (select "SynonymId", min_by("Text", ord) first_word
                   from syn where "Text" is not null group by 1) c using("SynonymId")
  where s."Text" is not null""")
block("stop_list", ["stop"], """
  select coalesce(list("Text"), []) l from stop""")
block("script_pairs", ["script_map"], """
  select list({'term': src, 'canon': dst} order by length(src) desc, ord) p from script_map""")

STOPX = (
    "array_to_string(list_filter(regexp_extract_all({c}, '" + SEG + "'), "
    "lambda s: not list_contains(stop_list.l, s)), '')"
)
SYNX = "list_reduce((select p from syn_pairs), lambda a, x: replace(a, x.term, x.canon), {c})"
SCRIPTX = "list_reduce((select p from script_pairs), lambda a, x: replace(a, x.term, x.canon), {c})"

block("faq_syn", ["faq", "syn_pairs"], f"""
  select ord, {SYNX.replace("{c}", '"Text"')} "Text", "FaqSettingId", "Demand", "Supply" from faq""")
block("faq_clean", ["faq_syn", "stop_list"], f"""
  select ord, {STOPX.replace("{c}", '"Text"')} "Text", "FaqSettingId", "Demand", "Supply" from faq_syn, stop_list""")
block("faq_band", ["faq_clean"], """
  select * from faq_clean
  where length("Text") between 2 and (select quantile_cont(length("Text"), 0.8) from faq_clean)""")
block("corpus_faq", ["faq_band"], """
  select * from faq_band qualify row_number() over (partition by "Text" order by ord) = 1""")

block("intent_clean", ["intent", "stop_list"], f"""
  select ord, {STOPX.replace("{c}", '"Text"')} "Text", "Rank", "IntentionName", "FaqSettingId"
  from intent, stop_list where "Rank" is distinct from 2""")
block("intent_band", ["intent_clean"], """
  select * from intent_clean
  where length("Text") between 2 and (select quantile_cont(length("Text"), 0.8) from intent_clean)""")
block("corpus_intent", ["intent_band"], """
  select * from intent_band qualify row_number() over (partition by "Text" order by ord) = 1""")

block("emo_conv", ["emo", "script_pairs"], f"""
  select ord, {SCRIPTX.replace("{c}", '"Question"')} "Question", {SCRIPTX.replace("{c}", '"EmotionName"')} "EmotionName"
  from emo where "EmotionName" is not null""")
block("emo_clean", ["emo_conv"], """
  select * from (
    select * from emo_conv
    where length("Question") between 4 and (select quantile_cont(length("Question"), 0.8) from emo_conv)
      and "Question" <> '')
  qualify row_number() over (partition by "Question" order by ord) = 1""")
block("emo_s", ["emo_clean"], """
  select n s from (select "EmotionName", count(*) n from emo_clean group by 1)
  order by n desc limit 1 offset 1""")
block("emo_capped", ["emo_clean", "emo_s"], """
  select ord, "Question", "EmotionName" from emo_clean
  qualify row_number() over (partition by "EmotionName"
                             order by md5(cast(ord as varchar) || '|42')) <= (select s from emo_s)""")
block("corpus_emo", ["emo_capped", "emo_s"], """
  select * from emo_capped
  union all
  select ord, "Question", "EmotionName" from (
    select c.*, row_number() over (partition by "EmotionName"
                                   order by md5(cast(ord as varchar) || '|43')) r,
           (select s from emo_s) - count(*) over (partition by "EmotionName") lack
    from emo_capped c)
  where r <= lack""")

# ---------------------------------------------------------------------------
# word lists
# ---------------------------------------------------------------------------
block("emo_words", ["corpus_emo", "stop"], f"""
  select length(w) word_len, w word, count(*) cnt
  from (select unnest(regexp_extract_all("Question", '{WORD}')) w from corpus_emo)
  where length(w) in (2, 3, 4) and w not in (select "Text" from stop where "Text" is not null)
  group by 1, 2""")
block("top_words", ["emo_words"], """
  select word_len, rank, word, cnt from (
    select *, row_number() over (partition by word_len order by cnt desc, word) rank from emo_words)
  where rank <= 10""")

ORACLE: dict[str, str] = {}

ORACLE["corpus_faq"] = with_("corpus_faq") + 'select ord, "Text", "FaqSettingId", "Demand", "Supply" from corpus_faq'
ORACLE["corpus_intent"] = with_("corpus_intent") + 'select ord, "Text", "Rank", "IntentionName", "FaqSettingId" from corpus_intent'
ORACLE["corpus_emo"] = with_("corpus_emo") + 'select ord, "Question", "EmotionName" from corpus_emo'
ORACLE["top_words"] = with_("top_words") + "select word_len, rank, word, cnt from top_words"
ORACLE["cloud_words"] = with_("top_words") + """select string_agg(word, ' ' order by word_len, rank) cloud,
  count(*) n_words from top_words"""

# ---------------------------------------------------------------------------
# single operators on the roles
# ---------------------------------------------------------------------------
ORACLE["synonym_replace"] = with_("faq_syn") + 'select ord, "Text" from faq_syn'
ORACLE["synonym_to_one"] = with_("faq", "syn") + """select ord,
  list_reduce((select list("Text" order by ord) from syn where "Text" is not null),
              lambda a, x: replace(a, x, ''), "Text") "Text" from faq"""
ORACLE["stopword_exclude"] = with_("intent", "stop_list") + 'select ord, ' + STOPX.replace("{c}", '"Text"') + ' "Text" from intent, stop_list'
ORACLE["strip_punct"] = with_("questions") + f"select qid, regexp_replace(text, '{PUNCT}', '', 'g') text from questions"
ORACLE["script_convert"] = with_("emo", "script_pairs") + f"""select ord,
  {SCRIPTX.replace("{c}", '"Question"')} "Question", {SCRIPTX.replace("{c}", '"EmotionName"')} "EmotionName" from emo"""
ORACLE["length_quantile"] = with_("intent") + """select round(quantile_cont(length("Text"), 0.8), 6) q80,
  round(quantile_cont(length("Text"), 0.5), 6) q50 from intent"""
ORACLE["length_band"] = with_("intent") + """select ord, length("Text") n_chars from intent
  where length("Text") between 2 and (select quantile_cont(length("Text"), 0.8) from intent)"""
ORACLE["rank_filter"] = with_("intent") + 'select ord, "Rank" from intent where "Rank" is distinct from 2'
ORACLE["dedup_first"] = with_("intent") + """select ord, "IntentionName" from intent
  qualify row_number() over (partition by "Text" order by ord) = 1"""
ORACLE["class_sizes"] = with_("emo_clean") + 'select "EmotionName", count(*) n from emo_clean group by 1'
ORACLE["second_size"] = with_("emo_s") + "select (select s from emo_s) s"
ORACLE["balance_cap"] = with_("emo_capped") + 'select ord, "EmotionName" from emo_capped'
ORACLE["balance_topup"] = with_("corpus_emo") + 'select ord, "EmotionName" from corpus_emo'
ORACLE["holdout_split"] = with_("corpus_intent") + """select ord,
  case when substr(md5(cast(ord as varchar) || '|42'), 1, 4) < 'cccd' then 'train' else 'test' end split
  from corpus_intent"""

# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------


def vocab_block(name: str, corpus: str, col: str) -> None:
    block(name, [corpus], f"""
  select ch, id, cnt from (
    select ch, cnt, row_number() over (order by cnt desc, ch) id
    from (select ch, count(*) cnt
          from (select unnest(regexp_extract_all("{col}", '{CHAR}')) ch from {corpus}) group by 1))
  where id <= 8190""")
    block(name + "_map", [name], f"""
  select coalesce(map_from_entries(list((ch, cast(id as integer)))), MAP {{}}) vm, count(*) + 1 oov from {name}""")


vocab_block("faq_vocab", "corpus_faq", "Text")
vocab_block("intent_vocab", "corpus_intent", "Text")
vocab_block("emo_vocab", "corpus_emo", "Question")

IDS = f"list_transform(regexp_extract_all({{c}}, '{CHAR}'), lambda ch: coalesce(vm[ch], oov))"

ORACLE["label_encode"] = with_("corpus_faq") + """select ord, "FaqSettingId",
  cast(dense_rank() over (order by "FaqSettingId") - 1 as integer) label_faq from corpus_faq"""
ORACLE["char_vocab"] = with_("intent_vocab") + "select ch, id, cnt from intent_vocab"
ORACLE["encode_pad"] = with_("corpus_faq", "faq_vocab_map") + f"""select ord,
  array_to_string(list_concat(ids, list_transform(range(ml - len(ids)), lambda x: 0)), ' ') ids
  from (select ord, {IDS.replace("{c}", '"Text"')} ids,
               (select max(length("Text")) from corpus_faq) ml
        from corpus_faq, faq_vocab_map)"""
ORACLE["encode_query"] = with_("corpus_faq", "faq_vocab_map", "questions") + f"""select qid,
  array_to_string(list_concat(k, list_transform(range(ml - len(k)), lambda x: 0)), ' ') ids
  from (select qid, ml, ids[greatest(len(ids) - ml + 1, 1):] k from (
    select qid, {IDS.replace("{c}", "text")} ids, (select max(length("Text")) from corpus_faq) ml
    from questions, faq_vocab_map))"""
ORACLE["encode_mask"] = with_("corpus_faq", "faq_vocab_map", "questions") + f"""select qid,
  array_to_string(list_concat(list_transform(range(ml - len(k)), lambda x: 0), k), ' ') ids,
  array_to_string(list_concat(list_transform(range(ml - len(k)), lambda x: 0),
                              list_transform(k, lambda x: 1)), ' ') mask
  from (select qid, ml, ids[1:ml] k from (
    select qid, {IDS.replace("{c}", "text")} ids, (select max(length("Text")) from corpus_faq) ml
    from questions, faq_vocab_map))"""


def stats_sql(head: str, corpus: str, col: str, label: str, vocab: str) -> str:
    return f"""select '{head}' head, count(*) n_rows, (select count(*) + 2 from {vocab}) vocab_size,
  max(length("{col}")) maxlen, count(distinct "{label}") n_classes,
  cast(floor(pow(count(*), 1 / exp(1))) as bigint) batch from {corpus}"""


ORACLE["corpus_stats"] = (
    with_("corpus_faq", "faq_vocab", "corpus_intent", "intent_vocab", "corpus_emo", "emo_vocab")
    + stats_sql("faq", "corpus_faq", "Text", "FaqSettingId", "faq_vocab")
    + " union all " + stats_sql("intent", "corpus_intent", "Text", "IntentionName", "intent_vocab")
    + " union all " + stats_sql("emo", "corpus_emo", "Question", "EmotionName", "emo_vocab")
)

# ---------------------------------------------------------------------------
# options
# ---------------------------------------------------------------------------
block("opt", ["options"], """
  select cast(arg_min_null("Value", ord) filter ("Key"='SimilarityFAQBot') as double) t_faq,
         cast(arg_min_null("Value", ord) filter ("Key"='SimilarityIntentionBot') as double) t_intent,
         cast(arg_min_null("Value", ord) filter ("Key"='4000Faq') as double) f,
         cast(arg_min_null("Value", ord) filter ("Key"='4000Intention') as double) i,
         cast(arg_min_null("Value", ord) filter ("Key"='4000Emo') as double) e
  from options""")
block("kinds", ["opt", "bot_model"], """
  select case when fn is not null and inn is not null and en is not null then fn else 'nb' end faq_kind,
         case when fn is not null and inn is not null and en is not null then inn else 'nb' end intent_kind,
         case when fn is not null and inn is not null and en is not null then en else 'logreg' end emo_kind
  from (select (select arg_min_null("Name", ord) from bot_model where "Id" = o.f) fn,
               (select arg_min_null("Name", ord) from bot_model where "Id" = o.i) inn,
               (select arg_min_null("Name", ord) from bot_model where "Id" = o.e) en from opt o)""")
block("thresholds", ["questions", "opt"], """
  select qid, coalesce(try_cast(threshold_faq as double), (select t_faq from opt)) t_faq,
         coalesce(try_cast(threshold_intent as double), (select t_intent from opt)) t_intent
  from questions""")
ORACLE["threshold_resolve"] = with_("thresholds") + "select qid, t_faq, t_intent from thresholds"
ORACLE["refresh_options"] = with_("opt", "kinds", "corpus_faq", "corpus_intent", "corpus_emo") + """select
  o.t_faq, o.t_intent, k.faq_kind, k.intent_kind, k.emo_kind,
  (select count(*) from corpus_faq) n_faq, (select count(*) from corpus_intent) n_intent,
  (select count(*) from corpus_emo) n_emo from opt o, kinds k"""

# ---------------------------------------------------------------------------
# relational naive Bayes (dense form: every question x every class)
# ---------------------------------------------------------------------------


def nb_blocks(h: str, corpus: str, text: str, label: str) -> None:
    block(f"{h}_idx", [corpus], f"""
  select lbl, cast(dense_rank() over (order by lbl) - 1 as integer) cls
  from (select distinct "{label}" lbl from {corpus})""")
    block(f"{h}_rows", [corpus, f"{h}_idx"], f"""
  select "{text}" txt, i.cls from {corpus} c join {h}_idx i on c."{label}" = i.lbl""")
    block(f"{h}_cnt", [f"{h}_rows"], f"""
  select tok token, cls, count(*) cnt
  from (select cls, unnest(regexp_extract_all(lower(txt), '{TOKEN}')) tok from {h}_rows) group by 1, 2""")
    block(f"{h}_cls", [f"{h}_idx", f"{h}_rows", f"{h}_cnt"], f"""
  select i.cls, i.lbl "{label}", d.docs, coalesce(n.n_tok, 0) n_tok,
         ln(d.docs) - ln((select count(*) from {h}_rows)) prior,
         ln(coalesce(n.n_tok, 0) + (select count(distinct token) from {h}_cnt)) ld
  from {h}_idx i join (select cls, count(*) docs from {h}_rows group by 1) d using(cls)
  left join (select cls, sum(cnt) n_tok from {h}_cnt group by 1) n using(cls)""")
    block(f"{h}_w", [f"{h}_cnt"], f"""
  select token, cls, ln(cnt + 1) w from {h}_cnt""")


def nb_score_blocks(h: str, qs: str, deps: list[str]) -> str:
    """Dense scores and probabilities of head ``h`` for question set ``qs``."""
    n = f"{h}_{qs}"
    block(f"{n}_qt", deps + [qs], f"""
  select qid, tok token, count(*) tf
  from (select qid, unnest(regexp_extract_all(lower(text), '{TOKEN}')) tok from {qs}) group by 1, 2""")
    block(f"{n}_qin", [f"{n}_qt", f"{h}_w"], f"""
  select * from {n}_qt where token in (select token from {h}_w)""")
    block(f"{n}_sc", [qs, f"{n}_qin", f"{h}_cls", f"{h}_w"], f"""
  select q.qid, c.cls, c.prior - coalesce(l.L, 0) * c.ld + coalesce(m.m, 0) s
  from (select qid from {qs}) q cross join {h}_cls c
  left join (select qid, sum(tf) L from {n}_qin group by 1) l on l.qid = q.qid
  left join (select t.qid, w.cls, sum(t.tf * w.w) m from {n}_qin t join {h}_w w using(token) group by 1, 2) m
    on m.qid = q.qid and m.cls = c.cls""")
    block(f"{n}_p", [f"{n}_sc"], f"""
  select qid, cls, s, exp(s - mx) / sum(exp(s - mx)) over (partition by qid) p
  from (select *, max(s) over (partition by qid) mx from {n}_sc)""")
    block(f"{n}_rk", [f"{n}_p"], f"""
  select *, row_number() over (partition by qid order by p desc, cls desc) rank from {n}_p""")
    return n


nb_blocks("hf", "corpus_faq", "Text", "FaqSettingId")
nb_blocks("hi", "corpus_intent", "Text", "IntentionName")
nb_blocks("he", "corpus_emo", "Question", "EmotionName")

block("qsyn", ["questions", "syn_pairs"], f"""
  select qid, {SYNX.replace("{c}", "text")} text, threshold_faq, threshold_intent from questions""")
block("qemo", ["qsyn"], f"""
  select qid, regexp_replace(text, '{PUNCT}', '', 'g') text from qsyn""")

HF = nb_score_blocks("hf", "qsyn", [])
HI = nb_score_blocks("hi", "qsyn", [])
HE = nb_score_blocks("he", "qemo", [])


def cls_sql(h: str, label: str) -> str:
    return with_(f"{h}_cls") + f"""select cls, "{label}", docs, n_tok, round(prior, 6) prior, round(ld, 6) ld
  from {h}_cls"""


ORACLE["train_faq"] = cls_sql("hf", "FaqSettingId")
ORACLE["train_intent"] = cls_sql("hi", "IntentionName")
ORACLE["train_emo"] = cls_sql("he", "EmotionName")
ORACLE["predict_proba"] = with_(f"{HI}_p") + f"select qid, cls, round(p, 3) p from {HI}_p"
ORACLE["softmax"] = with_(f"{HI}_sc") + f"""select qid, cls, round(exp(z - mz) / sum(exp(z - mz)) over (partition by qid), 3) p
  from (select *, max(z) over (partition by qid) mz from (select qid, cls, s / 10 z from {HI}_sc))"""
ORACLE["round_scores"] = with_(f"{HI}_p") + f"select qid, cls, round(p, 1) p from {HI}_p"
ORACLE["softmax_contrast"] = with_(f"{HI}_p") + f"""select qid, cls, round(exp(z - mz) / sum(exp(z - mz)) over (partition by qid), 3) p
  from (select *, max(z) over (partition by qid) mz from (
    select qid, cls, p * (max(p) over (partition by qid) - avg(p) over (partition by qid)) z from {HI}_p))"""
ORACLE["calib_intent"] = with_(f"{HI}_p") + f"""select qid, cls, round(p / sum(sqrt(p)) over (partition by qid), 3) p
  from {HI}_p"""
ORACLE["topk_classes"] = with_(f"{HI}_rk") + f"select qid, rank, cls, round(p, 3) p from {HI}_rk where rank <= 2"

block("faq_look", ["corpus_faq", "corpus_intent"], """
  select f."FaqSettingId", f.demand, f.supply, i.faq_intent
  from (select "FaqSettingId", arg_min_null("Demand", ord) demand, arg_min_null("Supply", ord) supply
        from corpus_faq group by 1) f
  left join (select "FaqSettingId", arg_min_null("IntentionName", ord) faq_intent
             from corpus_intent group by 1) i using("FaqSettingId")""")
ORACLE["faq_lookup"] = with_("faq_look") + 'select "FaqSettingId", demand, supply, faq_intent from faq_look'

block("rankfaq", [f"{HF}_rk", "hf_idx", "faq_look"], f"""
  select r.qid, r.rank, i.lbl faq_id, round(r.p, 3) similarity, l.demand, l.faq_intent, l.supply
  from {HF}_rk r join hf_idx i using(cls) left join faq_look l on l."FaqSettingId" = i.lbl
  where r.rank <= 4""")
ORACLE["rank_faq"] = with_("rankfaq") + "select qid, rank, faq_id, similarity, demand, faq_intent, supply from rankfaq"
ORACLE["calib_faq"] = with_(f"{HF}_rk") + f"""select qid, rank, round(sqrt(p * 100) / 10, 3) p
  from {HF}_rk where rank <= 4"""

ORACLE["score_offset"] = with_(f"{HE}_sc", "he_idx") + f"""select qid, lbl emotion from (
  select qid, cls, row_number() over (partition by qid order by
           s - case cls when 1 then 5.0 when 3 then -5.0 else 0.0 end desc, cls desc) r
  from {HE}_sc) x join he_idx using(cls) where r = 1"""

block("emo_pred", [f"{HE}_rk", "he_idx"], f"""
  select qid, lbl emotion from {HE}_rk join he_idx using(cls) where rank = 1""")
block("int_pred", [f"{HI}_rk", "hi_idx"], f"""
  select qid, max(case when rank = 1 then lbl end) pred_intent,
         max(case when rank = 1 then round(p, 3) end) i1
  from {HI}_rk join hi_idx using(cls) group by qid""")
block("ans1", ["rankfaq", "int_pred", "emo_pred", "thresholds"], """
  select r.qid, r.*, ip.pred_intent, ip.i1, e.emotion, t.t_faq, t.t_intent,
         (r.s1 < t.t_faq and ip.i1 < t.t_intent) fb
  from (select qid,
          max(case when rank=1 then similarity end) s1, max(case when rank=2 then similarity end) s2,
          max(case when rank=3 then similarity end) s3, max(case when rank=4 then similarity end) s4,
          max(case when rank=1 then faq_id end) f1, max(case when rank=2 then faq_id end) f2,
          max(case when rank=3 then faq_id end) f3, max(case when rank=4 then faq_id end) f4,
          max(case when rank=1 then demand end) d1, max(case when rank=2 then demand end) d2,
          max(case when rank=3 then demand end) d3, max(case when rank=4 then demand end) d4,
          max(case when rank=1 then faq_intent end) n1, max(case when rank=2 then faq_intent end) n2,
          max(case when rank=3 then faq_intent end) n3, max(case when rank=4 then faq_intent end) n4,
          max(case when rank=1 then supply end) answer
        from rankfaq group by qid) r
  join int_pred ip using(qid) left join emo_pred e using(qid) join thresholds t using(qid)""")
ORACLE["answer_v1"] = with_("ans1") + """select qid, 'parlance' "Bot", answer "Answer", d1 "Question",
  f1 "Answer_faqsettingid", n2 "Referral_intent_1", n3 "Referral_intent_2", n4 "Referral_intent_3",
  emotion, n1 intent, 1 "type", 1 "end", s1 max_prob, pred_intent, i1 pred_intent_prob,
  d2 "Referral_1", d3 "Referral_2", d4 "Referral_3",
  f2 "Referral_faqsettingid_1", f3 "Referral_faqsettingid_2", f4 "Referral_faqsettingid_3",
  s1 "Similarity_1", s2 "Similarity_2", s3 "Similarity_3", s4 "Similarity_4"
  from ans1"""

# ---------------------------------------------------------------------------
# linear FAQ head: three rounds of Adagrad, one CTE chain a round
# ---------------------------------------------------------------------------
block("lf_tok", ["hf_rows"], f"""
  select row, cls y, tok token, count(*) tf
  from (select row, cls, unnest(regexp_extract_all(lower(txt), '{TOKEN}')) tok
        from (select *, row_number() over () row from hf_rows)) group by 1, 2, 3""")
block("lf_idf", ["lf_tok", "hf_idx"], """
  select token, round(ln((select count(*) from hf_idx)::double / count(distinct y)), 9) idf
  from lf_tok group by token
  having count(distinct y) <= greatest(1.0, 0.25 * (select count(*) from hf_idx)) and count(distinct y) < (select count(*) from hf_idx)""")


def unit_rows(name: str, source: str, key: str, carry: str = "") -> None:
    block(name, [source, "lf_idf"], f"""
  select {key}, {carry} token, round(tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by {key})), 9) v
  from {source} join lf_idf using(token)""")


unit_rows("lf_x", "lf_tok", "row", "y,")
block("lf_w0", ["lf_x"], "  select token, y cls, 0.0::double w, 0.0::double a from lf_x where false")
for _r in range(3):
    block(f"lf_s{_r}", ["lf_x", f"lf_w{_r}"], f"""
  select row, y, cls, sum(s) s from (
    select row, y, cls, v * w s from lf_x join lf_w{_r} using(token)
    union all select distinct row, y, y, 0.0 from lf_x) group by 1, 2, 3""")
    block(f"lf_g{_r}", [f"lf_s{_r}", "lf_x", "hf_cls"], f"""
  select token, cls, sum(g * v) g from (
    select row, s.cls, case when s.cls = y then -greatest(2 - s, 0) else greatest(s, 0) end / docs g
    from lf_s{_r} s join hf_cls c on c.cls = s.cls) join (select row, token, v from lf_x) using(row)
  where g <> 0 group by 1, 2""")
    block(f"lf_w{_r + 1}", [f"lf_g{_r}", f"lf_w{_r}"], f"""
  select token, cls, round(w - 0.5 * g / sqrt(a + g * g), 9) w, round(a + g * g, 12) a from (
    select token, cls, sum(w) w, sum(a) a, sum(g) g from (
      select token, cls, 0.0 w, 0.0 a, g from lf_g{_r}
      union all select token, cls, w, a, 0.001 * w from lf_w{_r}) group by 1, 2)
  where a + g * g > 0 and round(a + g * g, 12) > 0""")
ORACLE["train_linear"] = with_("hf_cls", "lf_w3") + """select c.cls, c."FaqSettingId", c.docs, coalesce(n, 0) n_weights,
  round(w, 2) w_sum, round(a, 2) w_abs
  from hf_cls c left join (select cls, count(*) n, sum(w) w, sum(abs(w)) a from lf_w3 group by 1) using(cls)"""
block("lf_qtok", ["qsyn"], f"""
  select qid, tok token, count(*) tf
  from (select qid, unnest(regexp_extract_all(lower(text), '{TOKEN}')) tok from qsyn) group by 1, 2""")
unit_rows("lf_qx", "lf_qtok", "qid")
ORACLE["rank_linear"] = with_("qsyn", "hf_idx", "lf_qx", "lf_w3") + """select qid, lbl "FaqSettingId", round(exp(s) / z, 3) p from (
    select q.qid, i.cls, i.lbl, round(coalesce(m.s, 0), 9) s, sum(exp(round(coalesce(m.s, 0), 9))) over (partition by q.qid) z,
           row_number() over (partition by q.qid order by round(coalesce(m.s, 0), 9) desc, i.cls desc) r
    from qsyn q cross join hf_idx i
    left join (select qid, cls, sum(v * w) s from lf_qx join lf_w3 using(token) group by 1, 2) m on m.qid = q.qid and m.cls = i.cls)
  where r = 1"""

# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------
ORACLE["scan_role"] = with_("intent") + """select ord, "IntentionName" from intent where "IntentionName" = 'en'"""
ORACLE["questions"] = with_("questions") + "select qid, text, threshold_faq, threshold_intent from questions"

# ---------------------------------------------------------------------------
# sentiment, emotion features, cache refresh
# ---------------------------------------------------------------------------
nb_blocks("hs", "sent", "text", "positive")
HSQ = nb_score_blocks("hs", "questions", [])
ORACLE["sentiment"] = with_(f"{HSQ}_p", "hs_idx") + f"""select qid, round(p, 3) sentiment
  from {HSQ}_p join hs_idx using(cls) where lbl = 1"""

block("emo_q", ["corpus_emo"], """
  select distinct ord qid, "Question" text from corpus_emo""")
HEQ = nb_score_blocks("he", "emo_q", [])
HSE = nb_score_blocks("hs", "emo_q", [])
block("emo_f", [f"{HEQ}_p", f"{HSE}_p", "hs_idx"], f"""
  select e.qid ord,
         round(max(case when e.cls = 0 then e.p end), 3) f0, round(max(case when e.cls = 1 then e.p end), 3) f1,
         round(max(case when e.cls = 2 then e.p end), 3) f2, round(max(case when e.cls = 3 then e.p end), 3) f3,
         round(max(s.p), 3) f4
  from {HEQ}_p e
  join (select qid, p from {HSE}_p join hs_idx using(cls) where lbl = 1) s using(qid)
  group by e.qid""")
ORACLE["emo_features"] = with_("corpus_emo", "he_idx", "emo_f") + """select c.ord, c."EmotionName", i.cls label_emo,
  f.f0, f.f1, f.f2, f.f3, f.f4
  from corpus_emo c join he_idx i on i.lbl = c."EmotionName" join emo_f f using(ord)"""

# the streamed cache has one row per key
ORACLE["feature_stream"] = f"select distinct * from ({ORACLE['emo_features']})"

# out-of-fold features: three folds by hash of ord
FOLD = "cast(('0x' || substr(md5(cast(ord as varchar) || '|fold'), 1, 6))::bigint % 3 as integer)"
for _k in range(3):
    block(f"emo_not{_k}", ["corpus_emo"], f"""  select * from corpus_emo where {FOLD} <> {_k}""")
    block(f"sent_not{_k}", ["sent"], f"""  select * from sent where {FOLD} <> {_k}""")
    block(f"emo_in{_k}", ["corpus_emo"], f"""
  select distinct ord qid, "Question" text from corpus_emo where {FOLD} = {_k}""")
    nb_blocks(f"hek{_k}", f"emo_not{_k}", "Question", "EmotionName")
    nb_blocks(f"hsk{_k}", f"sent_not{_k}", "text", "positive")
    _e, _s = nb_score_blocks(f"hek{_k}", f"emo_in{_k}", []), nb_score_blocks(f"hsk{_k}", f"emo_in{_k}", [])
    block(f"oof{_k}", ["he_idx", f"hek{_k}_idx", f"hsk{_k}_idx", f"{_e}_p", f"{_s}_p"], f"""
  select e.qid ord, {_k} fold,
         """ + ", ".join(f"round(coalesce(max(case when a.cls = {i} then e.p end), 0.0), 3) f{i}" for i in range(4)) + f""", round(max(s.p), 3) f4
  from {_e}_p e join hek{_k}_idx i on i.cls = e.cls join he_idx a on a.lbl = i.lbl
  join (select qid, p from {_s}_p join hsk{_k}_idx using(cls) where lbl = 1) s using(qid)
  group by e.qid""")
ORACLE["stack_features"] = with_("corpus_emo", "he_idx", "oof0", "oof1", "oof2") + """select c.ord, c."EmotionName", i.cls label_emo, f.fold,
  f.f0, f.f1, f.f2, f.f3, f.f4
  from corpus_emo c join he_idx i on i.lbl = c."EmotionName"
  join (select * from oof0 union all select * from oof1 union all select * from oof2) f using(ord)"""


def emo_chain(sfx: str, q: float) -> None:
    block(f"emo_clean{sfx}", ["emo_conv"], f"""
  select * from (
    select * from emo_conv
    where length("Question") between 4 and (select quantile_cont(length("Question"), {q}) from emo_conv)
      and "Question" <> '')
  qualify row_number() over (partition by "Question" order by ord) = 1""")
    block(f"emo_s{sfx}", [f"emo_clean{sfx}"], f"""
  select n s from (select "EmotionName", count(*) n from emo_clean{sfx} group by 1)
  order by n desc limit 1 offset 1""")
    block(f"emo_capped{sfx}", [f"emo_clean{sfx}", f"emo_s{sfx}"], f"""
  select ord, "Question", "EmotionName" from emo_clean{sfx}
  qualify row_number() over (partition by "EmotionName"
                             order by md5(cast(ord as varchar) || '|42')) <= (select s from emo_s{sfx})""")
    block(f"corpus_emo{sfx}", [f"emo_capped{sfx}", f"emo_s{sfx}"], f"""
  select * from emo_capped{sfx}
  union all
  select ord, "Question", "EmotionName" from (
    select c.*, row_number() over (partition by "EmotionName"
                                   order by md5(cast(ord as varchar) || '|43')) r,
           (select s from emo_s{sfx}) - count(*) over (partition by "EmotionName") lack
    from emo_capped{sfx} c)
  where r <= lack""")
    block(f"emo_keys{sfx}", [f"corpus_emo{sfx}"], f"""
  select ord, "Question", "EmotionName",
         cast(dense_rank() over (order by "EmotionName") - 1 as integer) label_emo
  from corpus_emo{sfx}""")


emo_chain("7", 0.7)
emo_chain("8", 0.8)
block("f_same", ["emo_keys7", "emo_keys8"], """
  select o."Question", o."EmotionName", o.label_emo from emo_keys7 o
  join emo_keys8 c on o."Question" = c."Question" and o."EmotionName" = c."EmotionName" and o.label_emo = c.label_emo""")
block("f_keep", ["emo_keys7", "f_same"], """
  select * from emo_keys7 where "Question" in (select "Question" from f_same)""")
block("f_diff", ["emo_keys8", "f_same"], """
  select * from emo_keys8 where "Question" not in (select "Question" from f_same)""")
ORACLE["feature_same"] = with_("f_same") + 'select "EmotionName", label_emo, md5("Question") q from f_same'
ORACLE["feature_keep"] = with_("f_keep") + 'select ord, "EmotionName", label_emo from f_keep'
ORACLE["feature_diff"] = with_("f_diff") + 'select ord, "EmotionName", label_emo from f_diff'
ORACLE["feature_refresh"] = with_("f_keep", "f_diff", "emo_f") + """select ord, "EmotionName", label_emo, origin, f0, f1, f2, f3, f4
  from (select ord, "EmotionName", label_emo, 'new' origin from f_diff
        union all select ord, "EmotionName", label_emo, 'kept' origin from f_keep) join emo_f using(ord)"""

# ---------------------------------------------------------------------------
# evaluation of the nb intent head on the hash split
# ---------------------------------------------------------------------------
block("intent_split", ["corpus_intent"], """
  select *, case when substr(md5(cast(ord as varchar) || '|42'), 1, 4) < 'cccd' then 'train' else 'test' end split
  from corpus_intent""")
block("intent_train", ["intent_split"], "  select * from intent_split where split = 'train'")
nb_blocks("ht", "intent_train", "Text", "IntentionName")
block("eval_q", ["intent_split"], """  select ord qid, "Text" text, "IntentionName", split from intent_split""")
HTQ = nb_score_blocks("ht", "eval_q", [])
ORACLE["eval_report"] = with_("eval_q", "ht_idx", f"{HTQ}_rk") + f"""select 'IntentionName' head, 'nb' kind, split,
  count(*) n, round(avg(case when coalesce(pred = y, false) then 1.0 else 0.0 end), 4) accuracy,
  round(avg(-ln(greatest(coalesce(pt, 0.0), 1e-15))), 4) log_loss
  from (select q.qid, q.split, i.cls y,
               (select r.cls from {HTQ}_rk r where r.qid = q.qid and r.rank = 1) pred,
               (select r.p from {HTQ}_rk r where r.qid = q.qid and r.cls = i.cls) pt
        from eval_q q left join ht_idx i on i.lbl = q."IntentionName")
  group by split"""

# ---------------------------------------------------------------------------
# answers: v1 tuple, routing, stream
# ---------------------------------------------------------------------------
block("int_sims", [f"{HI}_rk"], f"""
  select qid, max(case when rank = 2 then round(p, 3) end) i2, max(case when rank = 3 then round(p, 3) end) i3
  from {HI}_rk group by qid""")
ORACLE["rank_faq_v1"] = with_("ans1", "int_sims") + """select qid, pred_intent, f1 best_id, answer,
  f2 next_id_1, f3 next_id_2, f4 next_id_3,
  d1 demand_1, d2 demand_2, d3 demand_3, d4 demand_4,
  n1 intent_1, n2 intent_2, n3 intent_3, n4 intent_4,
  s1 faq_p_1, s2 faq_p_2, s3 faq_p_3, s4 faq_p_4,
  i1 intent_p_1, i2 intent_p_2, i3 intent_p_3
  from ans1 join int_sims using(qid)"""
ORACLE["route_fallback"] = with_("ans1") + """select a.qid,
  case when fb then 'ChatBot' else 'parlance' end bot,
  case when fb then coalesce(x.answer, '""" + BUSY_TEXT + """') else a.answer end answer,
  case when fb then 0 else f1 end faq_id, s1 similarity,
  case when fb then null else d1 end demand_text,
  case when fb then 0 else f2 end referral_faq_id_1, case when fb then 0 else f3 end referral_faq_id_2,
  case when fb then 0 else f4 end referral_faq_id_3,
  case when fb then 0.0 else s2 end referral_similarity_1, case when fb then 0.0 else s3 end referral_similarity_2,
  case when fb then 0.0 else s4 end referral_similarity_3,
  n1 intent, n2 referral_intent_1, n3 referral_intent_2, n4 referral_intent_3,
  emotion, pred_intent "predIntent", i1 "predIntentProb"
  from ans1 a left join (select conv_id * 16777216 + turn - 1 qid, text answer
                         from conversations where role = 'assistant') x on x.qid = a.qid
"""
ORACLE["answers_sink"] = ORACLE["route_fallback"]
ORACLE["answer_stream"] = ORACLE["answer_v1"]
ORACLE["answer_hot_swap"] = f"select *, cast(1 as bigint) model_version from ({ORACLE['answer_v1']})"

ORACLE["synonym_canon"] = with_("faq", "syn") + """select s."SynonymId", s."Text" term, c.first_word, count(*) n_rows
  from syn s join (select "SynonymId", min_by("Text", ord) first_word from syn where "Text" is not null group by 1) c
    using("SynonymId")
  join faq f on contains(f."Text", s."Text")
  where s."Text" is not null
  group by 1, 2, 3"""

# ---------------------------------------------------------------------------
# model life cycle: which kinds, and that a saved model scores as before
# ---------------------------------------------------------------------------
for _q, _done in (("train_all", "trained"), ("load_all", "loaded")):
    ORACLE[_q] = with_("kinds") + f"""select 'faq' head, faq_kind kind, '{_done}' status from kinds
  union all select 'intent', intent_kind, '{_done}' from kinds
  union all select 'emo', emo_kind, '{_done}' from kinds
  union all select 'stack', 'gbt', '{_done}'"""
ORACLE["model_roundtrip"] = with_("questions") + """select count(*) n, count(*) n_equal, k kind
  from questions cross join (values ('nb'), ('logreg')) t(k) group by k"""
