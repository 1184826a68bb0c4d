"""The catalogue's queries in DuckDB's SQL, put together from shared common table expressions."""

from __future__ import annotations

import re

from tarnwood.functions.text import BIOMEDICAL_SUFFIXES, KEYPHRASE_STOPWORDS
from tarnwood.operators.strategies import STOPWORDS

WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
WS = r"[ \t\n\x0B\f\r]"
NOT_WS = r"[^ \t\n\x0B\f\r]"
LEAD = f"regexp_replace(regexp_extract(text, '^{WS}*(?:{NOT_WS}+{WS}+){{0,63}}{NOT_WS}+'), '[\\t\\n\\x0B\\f\\r]', ' ', 'g')"
ATIRE = "idf * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))"
PLUS = f"({ATIRE} + idf)"
IDF = "ln((any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double) + 1)"
INFO = "tf * log2(tf * avg_dl / dl * n / ttf)"
SPREAD = "0.5::double * log2(2 * pi() * tf * (1 - tf::double / dl))"
TFN = "(tf * log2(1 + avg_dl / dl))"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _top(source: str, k: int, by: str = "query_id") -> str:
    return f"select * from (select *, (row_number() over (partition by {by} order by round(score, 8) desc, doc_id))::int as rank from {source}) where rank <= {k}"


def _scored(expr: str, source: str = "m") -> str:
    return f"select query_id, doc_id, sum(qtf * {expr}) as score from {source} group by all"


def _leg(name: str, pairs: str, post: str, w: float, beta: bool) -> dict[str, str]:
    """The CTEs of a bigram leg."""
    weight = f"k.qtf * (s.idf / k.mean)" if beta else "k.qtf"
    mean = f"select q.query_id, q.term, q.qtf, sum(q.qtf * s.idf) over (partition by q.query_id) / sum(q.qtf) over (partition by q.query_id) as mean from {pairs} q join {name}_ts s using (term)"
    return {
        f"{name}_p": post,
        f"{name}_ts": f"select term, count(*) as df, {IDF} as idf from {name}_p, cs group by term",
        f"{name}_q": mean,
        f"{name}_sc": f"select k.query_id, p.doc_id, {w}::double * {weight} * {ATIRE.replace('idf', 's.idf')} as score from {name}_q k join {name}_ts s using (term) join {name}_p p using (term) join dl using (doc_id), cs",
    }


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDY = r"[A-Za-z0-9_]|[^\x00-\x7F]"

CTE: dict[str, str] = {
    "docs": "select doc_id, coalesce(text, '') as text from documents",
    "asks": "select item_id as query_id, coalesce(text, '') as text from benchmark",
    "w": f"select doc_id, {WORDS.format('text')} as t from docs",
    "qw": f"select query_id, {WORDS.format('text')} as t from asks",
    "dl": "select doc_id, len(t)::bigint as dl from w",
    "cs": "select count(*) as n, sum(dl)::bigint as total, avg(dl) as avg_dl from dl",
    "p": "select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from w) group by all",
    "ts": f"select term, count(*) as df, sum(tf)::bigint as ttf, {IDF} as idf from p, cs group by term",
    "qt": "select query_id, term, count(*) as qtf from (select query_id, unnest(t) as term from qw) group by all",
    "m": "select query_id, doc_id, qtf, tf, dl, df, ttf, idf, n, total, avg_dl from qt join ts using (term) join p using (term) join dl using (doc_id), cs",
    "atire": _scored(ATIRE),
    "plus": _scored(PLUS),
    "bm25l": _scored("idf * 2.2::double * (tf / (0.25::double + 0.75::double * dl / avg_dl) + 1) / (2.2::double + tf / (0.25::double + 0.75::double * dl / avg_dl))"),
    "ltd": _scored("idf * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * pow(dl / avg_dl, 0.5)))"),
    "dlh13": _scored(f"case when tf < dl then ({INFO} + {SPREAD}) / (tf + 0.5::double) else 0 end"),
    "dph": _scored(f"case when tf < dl then pow(1 - tf::double / dl, 2) / (tf + 1) * ({INFO} + {SPREAD}) else 0 end"),
    "pl2": _scored(f"({TFN} * log2({TFN} * n / ttf) + (ttf / n - {TFN}) / ln(2) + 0.5::double * log2(2 * pi() * {TFN})) / ({TFN} + 1)"),
    "dcm": _scored("ln(1 + tf * total / (avg_dl * ttf))"),
    "gp": "select doc_id, substr(term, i, k) as gram, sum(tf)::bigint as tf from p, (values (3), (4)) v(k), unnest(range(1, (length(term) - k + 2)::bigint)) r(i) group by all",
    "gdl": "select doc_id, coalesce(sum(tf), 0)::bigint as dl from docs left join gp using (doc_id) group by doc_id",
    "gcs": "select count(*) as n, avg(dl) as avg_dl from gdl",
    "gts": f"select gram, count(*) as df, sum(tf)::bigint as ttf, {IDF} as idf from gp, gcs group by gram having count(*) <= floor(0.5::double * any_value(n))",
    "qs": "select query_id, term, qtf, coalesce(df / (df + 5.0::double), 0) as share from qt left join ts using (term)",
    "qg": "select query_id, gram, sum(qtf * (1 - share)) as qtf from (select distinct query_id, term, qtf, share, substr(term, i, k) as gram from qs, (values (3), (4)) v(k), unnest(range(1, (length(term) - k + 2)::bigint)) r(i)) group by all",
    "sab_parts": f"select query_id, doc_id, qtf * share * {PLUS} as score from qs join ts using (term) join p using (term) join dl using (doc_id), cs union all select query_id, doc_id, qtf * {PLUS} from qg join gts using (gram) join gp using (gram) join gdl using (doc_id), gcs",
    "sab": "select query_id, doc_id, sum(score) as score from sab_parts group by all having sum(score) is not null",
    "pos": "select doc_id, i, t[i] as term from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from w)",
    "qpos": "select query_id, i, t[i] as term from (select query_id, t, unnest(range(1, len(t) + 1)) as i from qw)",
    "qob": "select a.query_id, a.term || ' ' || b.term as term, count(*) as qtf from qpos a join qpos b on a.query_id = b.query_id and b.i = a.i + 1 group by all",
    "qub": "select a.query_id, least(a.term, b.term) || ' ' || greatest(a.term, b.term) as term, count(*) as qtf from qpos a join qpos b on a.query_id = b.query_id and b.i = a.i + 1 where a.term <> b.term group by all",
    "ob": "select a.doc_id, a.term || ' ' || b.term as term, count(*) as tf from pos a join pos b on a.doc_id = b.doc_id and b.i = a.i + 1 group by all",
    "ub": "select a.doc_id, least(a.term, b.term) || ' ' || greatest(a.term, b.term) as term, count(*) as tf from (select *, i + d as j from pos, range(1, 9) o(d)) a join pos b on a.doc_id = b.doc_id and b.i = a.j group by all",
    "ub_need": "select u.* from ub u semi join qub q on u.term = q.term",
    **_leg("so", "qob", "select o.* from ob o semi join qob q on o.term = q.term", 0.10, False),
    **_leg("su", "qub", "select * from ub_need", 0.05, False),
    **_leg("wo", "qob", "select o.* from ob o semi join qob q on o.term = q.term", 0.10, True),
    **_leg("wu", "qub", "select * from ub_need", 0.05, True),
    "sdm": "select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.85::double * score as score from atire union all select * from so_sc union all select * from su_sc) group by all",
    "wsdm": "select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.85::double * score as score from atire union all select * from wo_sc union all select * from wu_sc) group by all",
    "aw": f"select doc_id, {WORDS.format(LEAD)} as t from docs",
    "adl": "select doc_id, len(t)::bigint as dl from aw",
    "acs": "select count(*) as n, avg(dl) as avg_dl from adl",
    "ap": "select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from aw) group by all",
    "ats": f"select term, count(*) as df, {IDF} as idf from ap, acs group by term",
    "aux": f"select query_id, doc_id, sum(qtf * {ATIRE}) as score from qt join ats using (term) join ap using (term) join adl using (doc_id), acs group by all",
    "bm25f": "select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.85::double * score as score from atire union all select query_id, doc_id, 0.15::double * score from aux) group by all",
    "qrels": "select query_id, doc_id, 1 as relevance from docs, asks where asks.text <> '' and contains(docs.text, asks.text)",
    "fb": f"select query_id, doc_id, score / sum(score) over (partition by query_id) as w from ({_top('atire', 10)}) where score > 0",
    "fb_given": "select query_id, doc_id, 1.0::double / count(*) over (partition by query_id) as w from qrels",
    "rm1": "select query_id, term, sum(tf::double / dl * w) as weight from fb join p using (doc_id) join dl using (doc_id) group by all",
    "rm_kept": "select query_id, term, weight / sum(weight) over (partition by query_id) as weight from (select *, row_number() over (partition by query_id order by round(weight, 12) desc, term) as rn from rm1) where rn <= 20",
    "rmx1": "select query_id, term, sum(tf::double / dl * w) as weight from fb_given join p using (doc_id) join dl using (doc_id) group by all",
    "rmx_kept": "select query_id, term, weight / sum(weight) over (partition by query_id) as weight from (select *, row_number() over (partition by query_id order by round(weight, 12) desc, term) as rn from rmx1) where rn <= 20",
    "qn": "select query_id, len(t) as n_q from qw",
    "rm3": f"select query_id, doc_id, sum(qtf * {ATIRE}) as score from (select query_id, term, sum(x) as qtf from (select query_id, term, 0.5::double * qtf / n_q as x from qt join qn using (query_id) union all select query_id, term, 0.5::double * weight from rm_kept) group by all) join ts using (term) join p using (term) join dl using (doc_id), cs group by all",
    "rmx_new": f"select query_id, doc_id, sum(qtf * {ATIRE}) as score from (select query_id, term, sum(x) as qtf from (select query_id, term, 0.5::double * qtf / n_q as x from qt join qn using (query_id) where query_id in (select query_id from rmx_kept) union all select query_id, term, 0.5::double * weight from rmx_kept) group by all) join ts using (term) join p using (term) join dl using (doc_id), cs group by all",
    "rm3x": "select * from rmx_new union all select * from atire where query_id not in (select query_id from rmx_kept)",
    "legs": "select 'atire' as leg, * from atire union all select 'plus', * from plus union all select 'bm25l', * from bm25l",
    "legs_top": "select * from (select *, row_number() over (partition by leg, query_id order by round(score, 8) desc, doc_id) as rank from legs)",
    "rrf": "select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from (select *, row_number() over (partition by leg, query_id order by round(score, 8) desc, doc_id) as rank from legs where score > 0) group by all",
    "pool": "select distinct query_id, doc_id from legs_top where rank <= 50",
    "pooled": "select leg, query_id, doc_id, coalesce(score, 0) as score from (select distinct leg from legs) cross join pool left join legs using (leg, query_id, doc_id)",
    "zed": "select query_id, doc_id, sum(case leg when 'atire' then 0.5::double when 'plus' then 0.3::double else 0.2::double end * (score - mu) / (sd + 1e-12)) as score from (select *, avg(score) over w as mu, stddev_pop(score) over w as sd from pooled window w as (partition by leg, query_id)) group by all",
    "mm": "select *, case when hi > lo then (score - lo) / (hi - lo) else 0 end as s from (select *, min(score) over w as lo, max(score) over w as hi from pooled window w as (partition by leg, query_id))",
    "minmax": "select query_id, doc_id, sum(case leg when 'atire' then 0.5::double when 'plus' then 0.3::double else 0.2::double end * s) as score from mm group by all",
    "combsum": "select query_id, doc_id, sum(s) as score from mm group by all",
    "feat0": "select query_id, term, qtf, df, ttf, idf, sum(qtf) over (partition by query_id) as n_q, total from qt left join ts using (term), cs",
    "feat": "select query_id, coalesce(sum(qtf), 0)::bigint as n_terms, coalesce(sum(case when df is null then qtf end), 0) / sum(qtf) as oov_rate, coalesce(sum(qtf * idf) / sum(case when df > 0 then qtf end), 0) as avg_idf, coalesce(max(idf), 0) as max_idf, coalesce(min(idf), 0) as min_idf, case when sum(case when df > 0 then qtf end) > 1 then sqrt(greatest(0, sum(qtf * idf * idf) / sum(case when df > 0 then qtf end) - pow(sum(qtf * idf) / sum(case when df > 0 then qtf end), 2))) else 0 end as idf_stddev, sum(qtf * length(term)) / sum(qtf) as avg_term_chars, coalesce(sum(qtf * (1 + ln(ttf)) * idf), 0) as scq, coalesce(sum(qtf / n_q * ln((qtf / n_q) / (ttf / total))), 0) as clarity from feat0 group by query_id",
    "features": "select asks.query_id, coalesce(n_terms, 0)::bigint as n_terms, coalesce(oov_rate, 0) as oov_rate, coalesce(avg_idf, 0) as avg_idf, coalesce(max_idf, 0) as max_idf, coalesce(min_idf, 0) as min_idf, coalesce(idf_stddev, 0) as idf_stddev, coalesce(avg_term_chars, 0) as avg_term_chars, coalesce(scq, 0) as scq, coalesce(clarity, 0) as clarity from asks left join feat using (query_id)",
    "full_atire": "select asks.query_id, docs.doc_id, coalesce(score, 0) as score from asks cross join docs left join atire using (query_id, doc_id)",
    "full_plus": "select asks.query_id, docs.doc_id, coalesce(score, 0) as score from asks cross join docs left join plus using (query_id, doc_id)",
    "top50": _top("full_atire", 50),
    "top10": _top("full_atire", 10),
    "other50": _top("full_plus", 50),
    "cmean": "select query_id, avg(score) as cm from full_atire group by query_id",
    "soft": "select *, exp(score - max(score) over w) / sum(exp(score - mx)) over w as prob from (select *, max(score) over (partition by query_id) as mx from top50) window w as (partition by query_id)",
    "post": "select query_id, max(case when rank = 1 then score end) as s1, max_by(score, case when rank <= 10 then rank end) as s10, avg(score) as mean, var_pop(score) as vr, -sum(case when prob > 0 then prob * ln(prob) end) as entropy from soft group by query_id",
    "jac": "select query_id, sum(case when a is not null and b is not null then 1 else 0 end) / count(*) as jaccard from (select coalesce(x.query_id, y.query_id) as query_id, x.doc_id as a, y.doc_id as b from top50 x full join other50 y on x.query_id = y.query_id and x.doc_id = y.doc_id) group by query_id",
    "ent0": "select *, exp(score - mx) / sum(exp(score - mx)) over (partition by query_id) as prob from (select *, max(score) over (partition by query_id) as mx from top10)",
    "ent": "select query_id, count(*) as k, case when count(*) >= 2 then -sum(case when prob > 1e-12 then prob * ln(prob) end) / ln(count(*)) else 0 end as entropy, case when count(*) >= 2 then (max(case when rank = 1 then score end) - max(case when rank = 2 then score end)) / greatest(1e-6, abs(max(case when rank = 1 then score end))) else 0 end as margin from ent0 group by query_id",
    "kp": f"select query_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda x: lower(x)), lambda x: x not in ({_quoted(KEYPHRASE_STOPWORDS)})))) as k from asks",
    "kph": "select query_id, doc_id, count(*) as hits from (select query_id, unnest(k) as term from kp) join p using (term) group by all",
    "kps": "select query_id, avg(score) as mu, stddev_pop(score) as sd from full_atire group by query_id",
    "boosted": "select a.query_id, a.doc_id, case when entropy < 0.3 or len(k) = 0 then score else (score - mu) / (sd + 1e-12) + 1 / (1 + exp(-(entropy - 0.48) * 8)) * 0.3::double * coalesce(hits, 0) / len(k) end as score from atire a left join kph using (query_id, doc_id) join kps using (query_id) join (select query_id, entropy from ent) using (query_id) join kp using (query_id)",
    "qlead": f"select query_id, term, count(*) as qtf from (select query_id, unnest({WORDS.format(LEAD)}) as term from asks) group by all",
    "related": f"select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.85::double * score as score from atire union all select query_id, doc_id, 0.15::double * qtf * {ATIRE} from qlead join ats using (term) join ap using (term) join adl using (doc_id), acs union all select query_id, doc_id, 2.0::double from qrels) group by all",
    "obs": f"select term, split_part(term, ' ', 1) as a, split_part(term, ' ', 2) as b, count(*) as df, sum(tf)::bigint as ttf, {IDF} as idf from ob, cs group by term",
    "obdl": "select doc_id, coalesce(sum(tf), 0)::bigint as dl from docs left join ob using (doc_id) group by doc_id",
    "obcs": "select count(*) as n, sum(dl)::bigint as pairs, avg(dl) as avg_dl from obdl",
    "concepts": "select o.term, o.a, o.b, ln((o.ttf / pairs) / ((x.ttf / total) * (y.ttf / total))) as pmi, o.idf, o.df, o.ttf from obs o join ts x on x.term = o.a join ts y on y.term = o.b, cs, obcs where o.ttf >= 5 and ln((o.ttf / pairs) / ((x.ttf / total) * (y.ttf / total))) >= 2",
    "cscore": f"select query_id, doc_id, sum(pmi * {ATIRE}) as score from (select query_id, term from qob) q join concepts using (term) join ob using (term) join obdl using (doc_id), obcs group by all",
    "bm25c": "select query_id, doc_id, sum(score) as score from (select query_id, doc_id, score from atire union all select query_id, doc_id, 0.5::double * score from cscore) group by all",
    "vocab": "select term as token, ttf as n from ts where ttf >= 5 order by n desc, token limit 50000",
    "vpos": "select doc_id, i, term from pos semi join vocab on token = term",
    "cooc": "select least(a.term, b.term) as a, greatest(a.term, b.term) as b, 2 * count(*) as n from (select *, i + d as j from vpos, range(1, 6) o(d)) a join vpos b on a.doc_id = b.doc_id and b.i = a.j group by all",
    "marg": "select a, sum(c) as c from (select a, case when a = b then n else n / 2 end as c from cooc union all select b, n / 2 from cooc where a <> b) group by a",
    "ppmi": "select a, b, ln(case when o.a = o.b then n else 2 * n end * d / (x.c * y.c)) as w from cooc o join marg x using (a) join (select a as b, c from marg) y using (b), (select sum(c) as d from marg)",
    "sig": f"select doc_id, term, weight from (select *, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rn from (select doc_id, term, greatest(0.25::double, idf) as weight from p join ts using (term) where length(term) >= 3 and term not in ({_quoted(STOPWORDS)}))) where rn <= 8",
    "qsig": f"select doc_id, term, weight from (select *, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rn from (select query_id as doc_id, term, greatest(0.25::double, coalesce(idf, 0)) as weight from qt left join ts using (term) where length(term) >= 3 and term not in ({_quoted(STOPWORDS)}))) where rn <= 8",
    "v": "select vec_id, label, list_transform(embedding, lambda x: x::double) as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as nrm from embeddings",
    "u": "select vec_id, label, list_transform(e, lambda x: x / nrm) as e from v where nrm > 0",
    "prs": "select 0 as query_id, a.label, a.vec_id as i, b.vec_id as j, list_dot_product(a.e, b.e) as sim from u a join u b on a.label = b.label and a.vec_id < b.vec_id",
    "gaps": "select label, sim, lead(sim) over w as nxt, row_number() over w as rn from prs window w as (partition by label order by sim desc)",
    "near10": "select a.vec_id as query_id, b.vec_id as doc_id, list_dot_product(a.e, b.e) as score from u a join u b on a.vec_id <> b.vec_id",
    "books": "select i as mi, k as ki, list_transform(range(0, 8), lambda j: sin((i * 131 + k * 17 + j * 7)::double)) as c from range(0, 8) a(i), range(0, 16) b(k)",
    "code0": "select vec_id, mi, ki, round(list_sum(list_transform(list_zip(list_slice(e, mi * 8 + 1, mi * 8 + 8), c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d from v, books",
    "codes": "select vec_id, mi, ki from (select *, row_number() over (partition by vec_id, mi order by d, ki) as rn from code0) where rn = 1",
    "ranked": _top("full_atire", 100),
    "nrel": "select query_id, count(*) as n_rel, sum(case when r <= 10 then 1.0::double / log2(r + 1) end) as ideal from (select query_id, row_number() over (partition by query_id order by doc_id) as r from qrels) group by query_id",
    "hit": "select r.query_id, r.rank from ranked r join qrels using (query_id, doc_id)",
    "perq": "select query_id, n_rel, ideal, coalesce(sum(case when rank <= 10 then 1.0::double / log2(rank + 1) end), 0) as dcg, count(case when rank <= 10 then 1 end) as h10, count(rank) as h100, min(case when rank <= 10 then rank end) as first from nrel left join hit using (query_id) group by all",
    "byts": "select doc_id, unnest(b) as x, generate_subscripts(b, 1) as i from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as b from docs)",
    "wins": "select doc_id, x || lead(x) over w || lead(x, 2) over w as g3, x || lead(x) over w || lead(x, 2) over w || lead(x, 3) over w as g4, x || lead(x) over w || lead(x, 2) over w || lead(x, 3) over w || lead(x, 4) over w as g5 from byts window w as (partition by doc_id order by i)",
    "bgrams": "select doc_id, g3 as gram, 3 as k from wins where g3 is not null union all select doc_id, g4, 4 from wins where g4 is not null union all select doc_id, g5, 5 from wins where g5 is not null",
    "dt": "select doc_id, list_distinct(t) as t from w",
    "pats": f"select min(query_id) as pid, p from (select query_id, {_FOLD.format('text')} as p from asks where text <> '') group by p",
    "occ": f"select doc_id, pid, p, f, parts, unnest(range(1, len(parts))) as k from (select doc_id, pid, p, f, string_split(f, p) as parts from (select doc_id, {_FOLD.format('text')} as f from docs) join pats on contains(f, p))",
    "spot": "select doc_id, pid, p, substr(f, 1, c) as pre, substr(f, c + 1 + length(p)) as post from (select *, (list_sum(list_transform(parts[1 : k], lambda x: length(x))) + (k - 1) * length(p))::bigint as c from occ)",
    "hits": f"select doc_id, pid, strlen(pre)::int as b, (strlen(pre) + strlen(p))::int as e from spot where not (pre <> '' and regexp_matches(right(pre, 1), '{_WORDY}') and regexp_matches(left(p, 1), '{_WORDY}')) and not (post <> '' and regexp_matches(left(post, 1), '{_WORDY}') and regexp_matches(right(p, 1), '{_WORDY}'))",
    "seq": "select *, row_number() over (partition by doc_id order by b, e desc, pid) as n from hits",
    "picks": "select doc_id, n, pid, b, e, true as taken, e as upto from seq where n = 1 union all select s.doc_id, s.n, s.pid, s.b, s.e, s.b >= p.upto, case when s.b >= p.upto then s.e else p.upto end from picks p join seq s on s.doc_id = p.doc_id and s.n = p.n + 1",
    "lns": "select doc_id, i, l[i] as line, regexp_replace(l[i], '^[ \\t\\x0B\\f\\r]*[0-9. ]*', '') as bare from (select doc_id, l, unnest(range(1, least(16, len(l)) + 1)) as i from (select doc_id, string_split(substr(text, 1, 16384), chr(10)) as l from docs))",
    "lnh": "select *, regexp_matches(bare, '[A-Za-z]') and len(regexp_extract_all(bare, '[^ \\t\\x0B\\f\\r]+')) <= 8 and (not regexp_matches(bare, '[a-z]') or strlen(bare) < 80) as header from lns",
    "lnp": "select *, coalesce(bool_or(header) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), false) as past, coalesce(sum(case when line <> '' and not header then length(line) + 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) - 1 as before from lnh",
    "auxf": "select docs.doc_id, coalesce(substr(string_agg(line, ' ' order by i), 1, 512), '') as aux from docs left join (select * from lnp where line <> '' and not header and (past or before < 256)) l using (doc_id) group by docs.doc_id",
    "sw": f"select doc_id, {WORDS.format('aux')} as t from auxf",
    "sdl": "select doc_id, len(t)::bigint as dl from sw",
    "scs": "select count(*) as n, avg(dl) as avg_dl from sdl",
    "sp": "select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from sw) group by all",
    "sts": f"select term, count(*) as df, {IDF} as idf from sp, scs group by term",
    "sci": f"select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.85::double * score as score from atire union all select query_id, doc_id, 0.15::double * qtf * {ATIRE} from qlead join sts using (term) join sp using (term) join sdl using (doc_id), scs) group by all",
}


def with_(final: str) -> str:
    """The statement with just the common table expressions that it needs."""
    need, todo = set(), [final]
    while todo:
        for name in set(re.findall(r"\b\w+\b", todo.pop())) & CTE.keys() - need:
            need.add(name)
            todo.append(CTE[name])
    parts = ",\n".join(f"{k} as ({CTE[k]})" for k in CTE if k in need)
    return f"with {'recursive ' if 'picks' in need else ''}{parts}\n{final}" if parts else final


def ranking(source: str, k: int = 10) -> str:
    return with_(f"select query_id, rank, doc_id, round(score, 6) as score from ({_top(source, k)})")


_SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+|\\n\\n'), lambda s: regexp_replace(s, '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g')), lambda s: s <> '')"
_SUFFIX = "[A-Za-z](?:" + "|".join(BIOMEDICAL_SUFFIXES) + ")$"


def _digest(*columns: str) -> str:
    line = " || '|' || ".join(f"coalesce(({c})::varchar, '')" for c in columns)
    return f"coalesce(sum(('0x' || substr(md5({line}), 1, 13))::bigint), 0)::varchar"


def mixed(source: str, keys: str) -> str:
    """(keys, h): SplitMix64's finaliser of the column z0 of a query."""
    two64 = "18446744073709551616"
    return (
        f"select {keys}, xor(z2, z2 >> 31) as h from (select {keys}, ((xor(z1, z1 >> 27))::uhugeint * 10723151780598845931 % {two64})::ubigint as z2 "
        f"from (select {keys}, ((xor(z0, z0 >> 30))::uhugeint * 13787848793156543929 % {two64})::ubigint as z1 from ({source})))"
    )


def hashed_head() -> str:
    """The shared expressions up to hashed(doc_id, gram, h), one row for each byte n-gram's occurrence."""
    from tarnwood.functions.hashing import GOLDEN, mix

    init = int(mix(GOLDEN ^ mix(0) ^ mix(0)))
    byte = lambda i: f"(case when k > {i} then (('0x' || substr(gram, {2 * i + 1}, 2))::ubigint << {8 * i}) else 0 end)"
    value = " + ".join(byte(i) for i in range(5))
    feats = f"select doc_id, gram, k, ({value})::ubigint as val from bgrams"
    one = mixed(f"select doc_id, gram, xor({init}::ubigint, xor(val, (k::ubigint << 56))) as z0 from feats", "doc_id, gram")
    two = mixed("select doc_id, gram, xor(h, (length(gram) // 2)::ubigint) as z0 from hashed1", "doc_id, gram")
    base = with_("select 1 from docs, bgrams").rsplit("\n", 1)[0]
    return f"{base}, feats as ({feats}), hashed1 as ({one}), hashed as ({two})"


def statements() -> dict[str, str]:
    ranked = {
        "bm25_atire": "atire", "bm25_plus": "plus", "bm25_l": "bm25l", "bm25_ltd": "ltd", "dlh13": "dlh13", "pl2": "pl2", "dph": "dph", "dcm": "dcm", "bm25_sab": "sab", "sdm": "sdm", "wsdm": "wsdm", "layered": "sdm", "layered_w": "wsdm",
        "bm25f_lead": "bm25f", "rm3": "rm3", "rm3_explicit": "rm3x", "rrf_variants": "rrf", "convex_z": "zed", "minmax_fusion": "minmax", "combsum": "combsum", "keyphrase_boost": "boosted", "relation_boost": "related", "concept_score": "cscore", "bm25_concepts": "bm25c",
    }
    out = {k: ranking(v) for k, v in ranked.items()}
    r = lambda *names: ", ".join(f"round({n}, 6) as {n}" for n in names)
    metric = lambda a, b: with_(f"select query_id, round(dcg / ideal, 6) as ndcg10, h10 / 10 as p10, round(h10 / {a}, 6) as r10, round(h100 / {b}, 6) as r100, round(coalesce(1 / first, 0), 6) as mrr10 from perq")
    grams = "select gram, count(distinct doc_id) as docs, count(*) as n from ({}) group by gram"
    hexed = "array_to_string(h[i + 1 : i + k], '')"
    plain = {
        "word_tokens": "select doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9_]+'), ' ') as tokens from docs",
        "byte_ngrams": grams.format("select doc_id, gram from bgrams"),
        "word_bounded_ngrams": grams.format(f"select doc_id, {hexed} as gram from (select doc_id, regexp_extract_all('3C' || hex(encode(x)) || '3E', '..') as h from (select doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+')) as x from docs)), (values (3), (4), (5)) v(k), unnest(range(0, (len(h) - k + 1)::bigint)) z(i)"),
        "lead_tokens": f"select doc_id, {LEAD} as lead from docs",
        "keyphrases": f"select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda x: lower(x)), lambda x: x not in ({_quoted(KEYPHRASE_STOPWORDS)})))), ' ') as phrases from docs",
        "sentence_split": f"select doc_id, (i - 1)::int as pos, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {_SENT} as s from docs))",
        "ascii_fold": f"select doc_id, md5({_FOLD.format('text')}) as folded from docs",
        "entities": f"select doc_id, array_to_string(list_slice(list_filter(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r.,;:!?()\"]+'), lambda x: (strlen(x) >= 5 and regexp_matches(x, '{_SUFFIX}')) or (strlen(x) >= 2 and regexp_full_match(x, '[^a-z]*[A-Z][^a-z]*')) or regexp_matches(x, '^[0-9]+[A-Za-z%]')), 1, 32), ' ') as entities from docs",
        "term_stats": f"select term, df, ttf, {r('idf')} from ts",
        "corpus_stats": f"select n, total, {r('avg_dl')} from cs",
        "bigram_ordered": "select term, count(*) as df, sum(tf)::bigint as ttf from ob group by term",
        "bigram_unordered": "select doc_id, count(*) as pairs, sum(tf)::bigint as dl from ub group by doc_id",
        "gram_stats_pruned": f"select gram as term, df, ttf, {r('idf')} from gts",
        "recipe_by_avgdl": "select case when avg_dl > 250 then 'ltd' else 'atire' end as recipe, case when avg_dl > 250 then 0.7::double else 1.0::double end as ltd_alpha, round(avg_dl, 6) as avg_dl from cs",
        "rm1_terms": f"select query_id, term, {r('weight')} from rm_kept",
        "query_features": f"select query_id, n_terms, {r('oov_rate', 'avg_idf', 'max_idf', 'min_idf', 'idf_stddev', 'avg_term_chars', 'scq', 'clarity')} from features",
        "query_features_post": "select query_id, round(case when s1 > 0 then least(1, greatest(0, (s1 - s10) / s1)) else 0 end, 6) as decay, round(case when mean > 0 then vr / mean else 0 end, 6) as normalised_var, round(case when cm > 0 then sqrt(vr) / cm else 0 end, 6) as nqc, round(case when n_terms > 0 then (mean - cm) / sqrt(n_terms) else 0 end, 6) as wig, round(entropy, 6) as entropy, round(jaccard, 6) as jaccard from post join cmean using (query_id) join features using (query_id) join jac using (query_id)",
        "route": "select query_id, case when n_terms = 0 or oov_rate > 0 then 'sab' when avg_idf > 3 then 'atire' when n_terms >= 4 and avg_idf <= 5 then 'cascade' else 'sab' end as recipe from features",
        "route_quality": "select query_id, case when n_terms = 0 or oov_rate > 0 or avg_idf > 3 or n_terms < 6 or avg_idf > 5 then 'bm25' when n_terms >= 12 and avg_idf <= 3 then 'geometry_max' else 'geometry' end as quality_recipe from features",
        "entropy_route": "select query_id, case when entropy < 0.05 then 'bm25' when entropy > 0.5 then 'keyphrase' else 'lead' end as strategy from ent",
        "assess_quality": "select query_id, round(case when k >= 2 then 3 * (1 - entropy) + margin else 0 end, 6) as quality from ent",
        "concepts": f"select term, a, b, df, ttf, {r('pmi', 'idf')} from concepts",
        "doc_concepts": f"select doc_id, term, {r('pmi')}, tf as n from ob join (select term, pmi from concepts) using (term)",
        "pmi_vocab": "select * from vocab",
        "pmi_cooc": "select * from cooc",
        "ppmi": f"select a, b, {r('w')} from ppmi where w > 0",
        "sparse_signature": f"select doc_id, term, {r('weight')} from sig",
        "signature_overlap": "select a, b, round(i / greatest(1e-6, least(x.s, y.s)), 6) as overlap from (select q.doc_id as a, d.doc_id as b, sum(least(q.weight, d.weight)) as i from qsig q join sig d using (term) group by all) join (select doc_id as a, sum(weight) as s from qsig group by all) x using (a) join (select doc_id as b, sum(weight) as s from sig group by all) y using (b)",
        "largest_gap": "select label, round(coalesce((arg_max(sim, [round(sim - nxt, 12), -rn]) + arg_max(nxt, [round(sim - nxt, 12), -rn])) / 2, max(sim)), 6) as scale from gaps where nxt is not null group by label",
        "max_persistence_scale": "select label, round(max(sim), 6) as scale from prs group by label",
        "cosine_topk": with_("") + f"select query_id, rank, doc_id, round(score, 6) as score from ({_top('near10', 10)})",
        "l2_normalize": "select vec_id, (i - 1)::int as dim, round(e[i], 6) as x from (select vec_id, e, unnest(range(1, len(e) + 1)) as i from u)",
        "prefix_normalize": "select vec_id, (i - 1)::int as dim, round(case when s > 0 then e[i] / s else 0 end, 6) as x from (select vec_id, e, sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))) as s, unnest(range(1, 17)) as i from v)",
        "matryoshka_weights": "select dim, round(sd / avg(sd) over (), 6) as weight from (select (i - 1)::int as dim, stddev_pop(e[i]) as sd from (select e, unnest(range(1, len(e) + 1)) as i from v) group by i)",
        "pq_encode_fixed": "select vec_id, array_to_string(list(ki order by mi), ' ') as code from codes group by vec_id",
        "adc_fixed": "select q.vec_id as query_id, c.vec_id, round(sum(list_sum(list_transform(list_zip(list_slice(q.e, c.mi * 8 + 1, c.mi * 8 + 8), b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) as l2, round(sum(list_dot_product(list_slice(q.e, c.mi * 8 + 1, c.mi * 8 + 8), b.c)), 6) as ip from v q, codes c join books b on b.mi = c.mi and b.ki = c.ki where q.vec_id % 50 = 0 group by q.vec_id, c.vec_id",
        "pq_decode": "select vec_id, (mi * 8 + i)::int as dim, round(c[i + 1], 6) as x from codes join books using (mi, ki), range(0, 8) r(i)",
        "dict_match_words": "select doc_id, pattern_id, count(*) as n from (select doc_id, pattern_id, w.t as t, q.t as p, unnest(range(1, len(w.t) - len(q.t) + 2)) as i from (select *, ' ' || array_to_string(t, ' ') || ' ' as line from w) w join (select query_id as pattern_id, t, ' ' || array_to_string(t, ' ') || ' ' as line from qw where len(t) > 0) q on contains(w.line, q.line)) where t[i : i + len(p) - 1] = p group by all",
        "dict_match": "select doc_id, pid as pattern_id, b as begin, e as end from picks where taken",
        "scientific": f"select query_id, rank, doc_id, round(score, 6) as score from ({_top('sci', 10)})",
        "concept_digest": f"select count(*) as rows, {_digest('term', 'round(pmi * 1e6)::bigint', 'round(idf * 1e6)::bigint', 'df', 'ttf')} as digest from concepts",
        "fixture_digest": f"select 'documents' as part, count(*) as rows, {_digest('doc_id', 'text')} as digest from documents union all select 'queries', count(*), {_digest('item_id', 'text')} from benchmark",
        "coordinate_digest": f"select count(*) as rows, {_digest('dim', 'round(weight * 1e6)::bigint')} as digest from (select dim, sd / avg(sd) over () as weight from (select (i - 1)::int as dim, stddev_pop(e[i]) as sd from (select e, unnest(range(1, len(e) + 1)) as i from v) group by i))",
        "aux_fields": "select doc_id, aux from auxf",
        "cluster_separation": "select a.label, count(distinct a.vec_id) as n, round(avg(case when a.label = b.label and a.vec_id <> b.vec_id then list_dot_product(a.e, b.e) end), 6) as intra, round(avg(case when a.label <> b.label then list_dot_product(a.e, b.e) end), 6) as inter from u a, u b group by a.label",
        "candidate_recall": "select query_id, round(count(h) / count(*), 6) as recall from qrels left join (select query_id, doc_id, 1 as h from top50) using (query_id, doc_id) group by query_id",
        "union_recall": "select query_id, round(count(h) / count(*), 6) as recall from qrels left join (select query_id, doc_id, 1 as h from pool) using (query_id, doc_id) group by query_id",
        "union_pool": "select query_id, doc_id from pool",
        "jaccard_terms": "select query_id, doc_id, round(c / (len(qd.t) + len(dt.t) - c), 6) as jaccard from (select query_id, doc_id, count(*) as c from qt join p using (term) group by all) join dt using (doc_id) join (select query_id, list_distinct(t) as t from qw) qd using (query_id)",
        "spearman": "select round(corr(ra, rb), 6) as rho, count(*) as n from (select rank() over (order by scq) + (count(*) over (partition by scq) - 1) / 2 as ra, rank() over (order by clarity) + (count(*) over (partition by clarity) - 1) / 2 as rb from features)",
        "latency_summary": "select role, round(avg(n), 6) as mean, max(case when rn = ceil(c * 0.5) then n end)::int as p50, max(case when rn = ceil(c * 0.95) then n end)::int as p95 from (select role, strlen(text) as n, row_number() over (partition by role order by strlen(text)) as rn, count(*) over (partition by role) as c from conversations where text is not null) group by role",
    }
    out |= {k: with_(v) for k, v in plain.items()}
    out["sentence_tokens"] = with_(
        f"select doc_id, (i - 1)::int as pos, array_to_string(list_slice(x, 1, 60), ' ') as tokens from (select doc_id, i, list_transform(list_filter(range(1, len(y) + 1), lambda k: list_position(y, y[k]) = k), lambda k: y[k]) as x from (select doc_id, i, list_filter(list_transform(regexp_extract_all(s[i], '[0-9A-Za-z_''\\-\\x{{80}}-\\x{{10FFFF}}]+'), lambda q: {_FOLD.format('q')}), lambda q: strlen(q) >= 2) as y from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {_SENT} as s from docs))))"
    )
    out["eval_trec"], out["eval_capped"] = metric("n_rel", "n_rel"), metric("least(10, n_rel)", "least(100, n_rel)")
    out["cosine_topk"] = ranking("near10")
    base_head = hashed_head()
    out["splitmix_sketch"] = f"{base_head} select doc_id, ((h % 4294967296) % 4096)::bigint as bucket, sum(case when h >= 9223372036854775808 then -2 else 2 end)::bigint as value from hashed group by all having sum(case when h >= 9223372036854775808 then -2 else 2 end) <> 0"
    out["idf_buckets"] = f"{base_head} select b::bigint as bucket, coalesce(df, 0)::bigint as df, greatest(0, least(65535, floor(1024 * ln(((select count(*) from docs) + 1) / (coalesce(df, 0) + 0.5::double)) + 0.5)))::bigint as w_q10 from range(0, 65536) r(b) left join (select (h % 65536)::bigint as b, count(distinct doc_id) as df from hashed group by all) using (b)"
    out["minhash_min_per_bin"] = f"{base_head} select doc_id, (h % 256)::bigint as bin, min(h // 4294967296)::bigint as least from hashed group by all"
    return out
