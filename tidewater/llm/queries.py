"""The operators' queries by name, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import ann, chat_format, embedding_dedup, language_id, license_scan, mixing, phrases, secret_scan, sentencepieces, simhash, token_counts, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_ann": ann.op6_ann,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_token_files": token_files.op9_token_files,
    "op10_sentencepieces": sentencepieces.op10_sentencepieces,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_phrases": phrases.op12_phrases,
    "op13_whitening": whitening.op13_whitening,
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": """with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and vec_id is not null),
        l as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
        r as (select vec_id x, vec_id c from v union select l.y, r.c from r join l on l.x = r.x)
        select e.vec_id, coalesce(n, 0) n_links, coalesce(m, e.vec_id) component_id, coalesce(m, e.vec_id) = e.vec_id kept from embeddings e
        left join (select x, count(*) n from l group by 1) a on a.x = e.vec_id left join (select x, min(c) m from r group by 1) b on b.x = e.vec_id""",
    "op5_chat_format": """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
        sum(length(text) + len(regexp_extract_all(text, '[<\\[]\\\\*/?(?:s>|INST\\]|TURN\\])')) + case role when 'user' then 15 when 'assistant' then 4
            else 17 + length(role) + len(regexp_extract_all(role, '[<\\[]\\\\*/?(?:s>|INST\\]|TURN\\])')) end)::bigint formatted_chars from t group by conv_id""",
    "op12_phrases": r"""with p as (select coalesce(lang, 'und') lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w from documents),
        f as (select lang, k, g, count(*) f from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) g from p, (values (1), (2), (3)) t(k) where len(w) >= k) x group by all),
        c as (select lang, k, g, f, string_split(g, ' ') w from f where k > 1 and f >= 10),
        s as (select c.lang, c.g, c.k, c.f a, l.f l, r.f r, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) score, row_number() over (partition by c.lang, c.g order by (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f), j) o
            from (select *, unnest(range(1, k)) j from c) c join f l on l.lang = c.lang and l.g = array_to_string(c.w[1:j], ' ') join f r on r.lang = c.lang and r.g = array_to_string(c.w[j + 1:], ' ')),
        v as (select lang, g, max(f) m from (select lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) g from c where k = 3) x group by 1, 2),
        n as (select lang, sum(f)::bigint n from f where k = 1 group by 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, g) as rank, g phrase, a, l, r, n, score::bigint score from s join n using (lang) left join v using (lang, g)
        where o = 1 and not coalesce(k = 2 and 100 * m >= 50 * a, false) qualify rank <= 2000""",
}
