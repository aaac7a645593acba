"""DuckDB SQL of the queries that SQL can express on whole tables.

Language ID, the class model and co-training have trained models, crc32 has no
DuckDB function, and the recursive components of op2 are too slow in SQL on whole
texts: those queries are tested against brute force.
"""

from __future__ import annotations

from .mixing import PASSES, ROWS_A_BUCKET
from .shared import LOWER, UPPER
from .urlfilter import RULES

AZ = f"'{UPPER}','{LOWER}'"
WORDS = r"regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+')"
TOKENS = rf"regexp_extract_all(translate(coalesce(text,''),{AZ}),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORDS} w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12],' ') g FROM (SELECT doc_id, w, unnest(range(1,len(w)-11)) i FROM d WHERE len(w)>=13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i,i+13)) p FROM (SELECT doc_id, i, g, min(doc_id) OVER (PARTITION BY g) first FROM win) WHERE doc_id>first),
word AS (SELECT doc_id, unnest(w) x, unnest(range(1,len(w)+1)) p FROM d),
kept AS (SELECT word.doc_id, count(*) n, string_agg(x,' ' ORDER BY word.p) t FROM word ANTI JOIN gone ON gone.doc_id=word.doc_id AND gone.p=word.p GROUP BY 1)
SELECT d.doc_id, len(w)::bigint n_words, (len(w)-coalesce(n,0))::bigint n_removed, sha256(coalesce(t,'')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

MIXING = f"""WITH d AS (SELECT doc_id, source, len({WORDS})::bigint size, md5(coalesce(doc_id::varchar,'')||':11') place FROM documents),
n AS (SELECT greatest(16,ceil(count(*)/{ROWS_A_BUCKET}))::bigint b FROM d),
e AS (SELECT d.*, ('0x'||substr(place,1,8))::bigint % b bucket FROM d, n),
t0 AS (SELECT source, sum(size)::bigint source_size FROM d GROUP BY 1),
t1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1)::double weight FROM t0),
t2 AS (SELECT *, source_size*{float(PASSES)!r}::double cap, source_size*{float(PASSES)!r}::double/weight ratio, sum(source_size) OVER ()::double total, sum(weight) OVER () weights FROM t1),
t3 AS (SELECT *, greatest(0,total-coalesce(sum(cap) OVER o,0))/(weights-coalesce(sum(weight) OVER o,0)) lev FROM t2 WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t4 AS (SELECT *, max(CASE WHEN lev<=ratio THEN lev END) OVER () fin FROM t3),
t AS (SELECT source, source_size, CASE WHEN fin IS NULL THEN cap ELSE least(cap,fin*weight) END target FROM t4),
p AS (SELECT row_number() OVER () id, e.doc_id, e.source, e.size, t.source_size, t.target, sum(e.size) OVER (PARTITION BY e.source ORDER BY bucket, place, e.doc_id, e.size ROWS UNBOUNDED PRECEDING)-e.size start FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
q AS (SELECT id, source, size, target, start+k*source_size AS begin, k FROM p, range({PASSES}) r(k) WHERE size>0),
f AS (SELECT *, CASE WHEN begin+size<=target OR begin>=target THEN size ELSE floor(target-begin)::bigint END offered, CASE WHEN begin+size<=target OR begin>=target THEN (begin+size)/target ELSE 1 END finish FROM q),
c AS (SELECT id, offered, sum(offered) OVER (ORDER BY finish, source, begin ROWS UNBOUNDED PRECEDING)-offered ahead FROM f),
b AS (SELECT sum(floor(target))::bigint budget FROM t),
s AS (SELECT id, sum(greatest(0,least(offered,budget-ahead)))::bigint taken FROM c, b GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken,0) taken FROM p LEFT JOIN s USING (id)"""

DECONTAMINATION = f"""WITH b AS (SELECT item_id, {TOKENS} w FROM benchmark),
k AS (SELECT *, least(13,len(w)) k FROM b WHERE len(w)>0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1],' ') g FROM (SELECT item_id, w, k, unnest(range(1,len(w)-k+2)) i FROM k)),
d AS (SELECT doc_id, {TOKENS} w FROM documents),
h AS (SELECT x.doc_id, x.i, x.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i+k-1],' ') g FROM (SELECT doc_id, w, s.k k, unnest(range(1,len(w)-s.k+2)) i FROM d, (SELECT DISTINCT k FROM g) s)) x JOIN g ON g.k=x.k AND g.g=x.g),
c AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i,i+k)) p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) n, string_agg(item_id,',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id::varchar item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::bigint n_words, coalesce(c.n,0) n_hit, coalesce(s.n,0) n_items, sha256(coalesce(ids,'')) items_sha256, coalesce(c.n,0)>0 AND 20*coalesce(c.n,0)>=len(w) contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

_RULES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_CASE = " ".join(f"WHEN (host='{h}' OR ends_with(host,'.{h}')) AND starts_with(path,'{p}') THEN '{{{i}}}'" for i, (h, p, _) in enumerate(_RULES))
_RULE = "CASE " + _CASE.format(*[h + p for h, p, _ in _RULES]) + " END"
_VERDICT = "CASE " + _CASE.format(*[v for *_, v in _RULES]) + " END"
URLS = f"""WITH u AS (SELECT page_id, html, CASE WHEN contains(url,'://') THEN substr(url,instr(url,'://')+3) ELSE '' END r FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(r,'(?s)^([^/?#]*)',1),{AZ}) host, regexp_extract(r,'(?s)^[^/?#]*([^?#]*)',1) path FROM u),
c AS (SELECT *, regexp_replace(host,'^www\\.','')||regexp_replace(path,'/+$','') canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE len(regexp_extract_all(coalesce(html,''),'<p[ >]'))<2)
SELECT page_id, coalesce(host,'') host, coalesce(path,'') path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) verdict FROM c"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e,e)) n FROM v WHERE len(e)>0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0),
p AS (SELECT a.vec_id a, b.vec_id b FROM g a JOIN g b ON a.vec_id<>b.vec_id AND a.n>0 AND b.n>0 AND list_dot_product(a.e,b.e)>=0.9*a.n*b.n),
r AS (SELECT vec_id a, vec_id b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a=r.b),
c AS (SELECT a vec_id, min(b) component_id FROM r GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a=v.vec_id) n_links, component_id, component_id=v.vec_id AS kept FROM v JOIN c USING (vec_id)"""


def _books(last: int, new: int) -> str:
    """Assignment by codebooks `last` and the codebooks that it gives."""
    return f"""a{new} AS ({_assigned(last)}),
u{new} AS (SELECT p,e,i,sum(x)::bigint s,count(*) n FROM (SELECT p,e,unnest(range(len(v))) i,unnest(v) x FROM a{new}) GROUP BY ALL),
n{new} AS (SELECT p,e,list((s-((s%n)+n)%n)//n ORDER BY i) v FROM u{new} GROUP BY p,e),
b{new} AS (SELECT b{last}.p,b{last}.e,coalesce(n.v,b{last}.v) v FROM b{last} LEFT JOIN n{new} n USING (p,e))"""


def _assigned(books: int) -> str:
    far = "list_sum(list_transform(list_zip(r.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))::bigint"
    return f"SELECT vec_id,label,p,any_value(v) v,arg_min(e,(d,e)) e,min(d) d FROM (SELECT r.vec_id,r.label,r.p,r.v,b.e,{far} d FROM r JOIN b{books} b USING (p)) GROUP BY vec_id,label,p"


VECTOR_CODES = f"""WITH k AS (SELECT vec_id,label,list_transform(embedding, lambda x: floor(256*x::double)::bigint) q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
r AS (SELECT vec_id,label,p,q[p*d+1:(p+1)*d] v FROM k, (SELECT max(len(q))//16 d FROM k), range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id)-1 e, v FROM r QUALIFY e<64),
{_books(0, 1)},
{_books(1, 2)},
c AS (SELECT vec_id,label,string_agg(printf('%02x',e::bigint),'' ORDER BY p) code,sum(d)::bigint AS error FROM ({_assigned(2)}) GROUP BY vec_id,label),
s AS (SELECT sha256(string_agg(array_to_string(v,','),',' ORDER BY p,e)) sha FROM b2)
SELECT vec_id,code,error,sum(error) OVER (PARTITION BY label)::bigint label_error,sha codebooks_sha256 FROM c, s"""

FILTER_AUDIT = r"""WITH w AS (SELECT doc_id, coalesce(lang,'') part, coalesce(text,'') x, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT doc_id, max((quality=1)::int) good, max((toxic=1)::int) toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(w)<200)::int+2*(100*len(list_distinct(w))<50*len(w))::int+4*(100*length(regexp_replace(x,'[^A-Z]+','','g'))>3*length(x))::int+8*regexp_matches(x,'[#$%&*|]')::int+16*coalesce(doc_id>min(doc_id) OVER (PARTITION BY x),false)::int mask, coalesce(good,0) good, coalesce(toxic,0) toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY ALL),
f AS (SELECT range::int i, chr(65+range::int) x FROM range(5)),
o AS (SELECT a.x||b.x||c.x||d.x||e.x filter_order, [a.i,b.i,c.i,d.i,e.i] p FROM f a JOIN f b ON b.i<>a.i JOIN f c ON c.i NOT IN (a.i,b.i) JOIN f d ON d.i NOT IN (a.i,b.i,c.i) JOIN f e ON e.i NOT IN (a.i,b.i,c.i,d.i)),
s AS (SELECT filter_order, step, (1<<p[step])::int bit, coalesce(list_sum(list_transform(p[1:step-1], lambda v: (1<<v)::int)),0)::int past FROM o, (SELECT unnest(range(1,6))::int step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask&(past|bit)=0),0)::bigint kept, coalesce(sum(n) FILTER (mask&past=0 AND mask&bit>0),0)::bigint removed, coalesce(sum(n) FILTER (mask&past>0 AND mask&bit>0),0)::bigint redundant, coalesce(sum(n) FILTER (mask=bit),0)::bigint unique_fails, coalesce(sum(good) FILTER (mask&past=0 AND mask&bit>0),0)::bigint good_lost, coalesce(sum(toxic) FILTER (mask&past=0 AND mask&bit>0),0)::bigint toxic_lost FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part,bit)::bigint shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": SUBSTRING, "op5_mixing": MIXING, "op7_decontamination": DECONTAMINATION, "op9_url_filter": URLS, "op10_embedding_dedup": EMBEDDINGS, "op12_vector_codes": VECTOR_CODES, "op13_filter_audit": FILTER_AUDIT}
