"""DuckDB SQL for the training-data queries that SQL can express, over whole tables and texts."""

from boxloom.llm.quality import RULES

ORACLES: dict[str, str] = {}

ORACLES["op2_quality_rules"] = r"""
with d as (select doc_id, coalesce(text,'') t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x<>'') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) l from d),
m as (select doc_id, len(w) n_words, length(array_to_string(w,'')) word_chars, length(regexp_replace(t,'[^#*$%&|<>]','','g')) n_symbols, len(l) n_lines, len(l)-len(list_distinct(l)) n_dup_lines,
 length(regexp_replace(t,'[^!]','','g')) n_marks, length(regexp_replace(t,'[^\p{Lu}]','','g')) up, length(regexp_replace(t,'[^\p{Ll}]','','g')) low from w),
i as (select doc_id, w, unnest(range(1, len(w)-1)) i from w where len(w)>=3),
g as (select doc_id, list(i) p from i group by doc_id, w[i], w[i+1], w[i+2] having count(*)>1),
c as (select doc_id, count(distinct i+k) n from (select doc_id, unnest(p) i from g), (select unnest([0,1,2]) k) group by 1),
a as (select m.*, coalesce(c.n,0) n_repeat_words from m left join c using (doc_id)),
f as (select *, (n_words<50)::int + 2*(100*n_repeat_words>50*n_words)::int + 4*(10*n_symbols>3*n_words)::int + 8*(2*n_dup_lines>n_lines)::int
 + 16*(n_words>0 and (word_chars<2*n_words or word_chars>20*n_words))::int + 32*(10*n_marks>3*n_words)::int + 64*(up+low>0 and 2*up>up+low)::int failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed&3<>0 base_failed, failed=0 kept, failed::bigint failed from f"""

ORACLES["quality_ablations"] = f"""
with q as ({ORACLES["op2_quality_rules"].strip()})
select rule, count(*) filter (failed & rule_bit <> 0) n_failed, count(*) filter (failed = rule_bit) n_only, count(*) filter (failed - (failed & rule_bit) = 0) n_kept_without
from q, (select unnest([{", ".join(f"'{name}'" for name in RULES)}]) rule, unnest([{", ".join(f"{1 << bit}::bigint" for bit, _ in RULES.values())}]) rule_bit) r group by rule"""

_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontamination"] = f"""
with b as (select coalesce(item_id::varchar,'') item, {_WORDS} w from benchmark), d as (select doc_id, {_WORDS} w from documents),
win as (select distinct item, least(13,len(w)) n, array_to_string(list_slice(w,i,i+least(13,len(w))-1),' ') t from (select item, w, unnest(range(1,greatest(1,len(w)-12)+1)) i from b where len(w)>0)),
sz as (select distinct n from win),
pos as (select doc_id, n, i, array_to_string(list_slice(w,i,i+n-1),' ') t from (select doc_id, w, n, unnest(range(1,len(w)-n+2)) i from d, sz where len(w)>=n)),
hit as (select doc_id, i, pos.n, item from pos join win on win.t=pos.t and win.n=pos.n),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i,i+n)) p from hit) group by 1),
its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hit group by 1)
select doc_id, len(w) n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, sha256(coalesce(items,'')) items_sha256, coalesce(n_hit,0)>0 and 20*n_hit>=len(w) contaminated
from d left join cov using (doc_id) left join its using (doc_id)"""

ORACLES["op9_mixing"] = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^ \x09-\x0D]+')) size, md5('42:'||coalesce(doc_id::varchar,'')) key from documents),
s as (select *, [3,1,2][sid%3+1] w, 2*source_size room from (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last)-1 sid from d group by 1)),
f(factor) as (select 1.5::double*sum(source_size)/sum(w) from s union select ((select 1.5::double*sum(source_size) from s) - (select coalesce(sum(room),0) from s where room<f.factor*w)) / (select sum(w) from s where room>=f.factor*w) from f),
t as (select s.*, case when room<x.factor*w then room::double else x.factor*w end target from s, (select max(factor) factor from f) x),
h as (select floor(sum(target)/32+0.5)::bigint seats from t),
q as (select sid, count(*) source_quota from (select sid, row_number() over (order by target/(2*k+1) desc, sid) r from (select sid, target, unnest(range(0, (target/32)::bigint+30)) k from t)), h where r<=seats group by 1),
e as (select d.*, sid, source_size, target, coalesce(source_quota,0) source_quota, ('0x'||substr(key,1,8))::bigint % greatest(ceil(source_size/262144.0),1)::bigint shard from d join t on d.source is not distinct from t.source left join q using (sid)),
p as (select *, sum(size) over (partition by sid, shard order by key, doc_id, size rows unbounded preceding)-size start from e),
c as (select sid, shard, sum(size)::bigint n, any_value(source_quota) source_quota from e group by 1, 2),
k as (select sid, shard, count(*) quota from (select sid, shard, source_quota, row_number() over (partition by sid order by n/(2*k+1)::double desc, shard) r from (select *, unnest(range(0, 2*(n//32+30))) k from c)) where r<=source_quota group by 1, 2),
b as (select sid, shard, ceil(n/32.0)::bigint n_blocks, least(coalesce(quota,0), 2*ceil(n/32.0)::bigint) quota from c left join k using (sid, shard) where n>0),
x as (select sid, shard, block from (select *, row_number() over (partition by sid, shard order by md5(concat_ws(':',42,sid,shard,block)), block) r from (select *, unnest(range(n_blocks)) block from b)) where r<=quota%n_blocks),
o as (select p.doc_id, p.key, p.sid, p.start, sum(least(p.start+p.size,(block+1)*32)-greatest(p.start,block*32)) extra from p join x on x.sid=p.sid and x.shard=p.shard and block between p.start//32 and (p.start+p.size-1)//32 where p.size>0 group by all)
select p.doc_id, p.size::bigint size, p.source_size, p.target, (case when p.size=0 then 0 else (quota//n_blocks)*p.size+coalesce(extra,0) end)::bigint taken
from p left join b using (sid, shard) left join o on o.sid=p.sid and o.start=p.start and o.doc_id is not distinct from p.doc_id and p.size>0"""
