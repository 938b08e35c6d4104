"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from tessera.llm.additive_ann import op2_additive_ann
from tessera.llm.exact_dedup import op6_exact_dedup
from tessera.llm.language_id import op5_language_id
from tessera.llm.license_scan import op4_license_scan
from tessera.llm.mixing import op9_sainte_lague_mixing
from tessera.llm.packing import op7_kk_packing
from tessera.llm.secret_scan import op1_secret_scan
from tessera.llm.simhash_dedup import op3_simhash_bktree
from tessera.llm.substring_dedup import op8_cdc_substrings
from tessera.llm.toxicity import op10_toxicity_knn

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_additive_ann,
        op3_simhash_bktree,
        op4_license_scan,
        op5_language_id,
        op6_exact_dedup,
        op7_kk_packing,
        op8_cdc_substrings,
        op9_sainte_lague_mixing,
        op10_toxicity_knn,
    )
}

_MIX = r"""
with w as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size, md5('42:' || coalesce(doc_id::varchar, '-')) k from documents),
placed as (select doc_id, source, size, sum(size) over (partition by source order by k rows unbounded preceding) - size pos from w),
s1 as (select source, sum(size) source_size from w group by 1),
s2 as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double weight, source_size * 2.0::double cap from s1),
s3 as (select *, cap / weight ratio, sum(source_size) over () * 1.5::double total from s2),
s4 as (select *, coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) capped,
  sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) open from s3),
lv as (select (total - capped) / open l from s4 where capped + ratio * open >= total order by ratio, l desc limit 1),
goal as (select source, source_size, coalesce(least(cap, (select l from lv) * weight), cap) target from s4),
b as (select greatest(1, least(32, ceil(sum(source_size) / 4096)), ceil(sum(source_size) / 1048576))::bigint block, sum(target) target from goal),
seats as (select block, round_even(target / block, 0)::bigint seats, target from b),
quot as (select source, s, g.target / (2 * s + 1) q from goal g, seats z, range(0, (ceil(z.seats * g.target / z.target) + 30)::bigint) r(s)),
won as (select source, count(*) won from (select * from quot qualify row_number() over (order by q desc, source nulls last, s) <= (select seats from seats)) group by 1),
plan as (select g.*, ceil(source_size / block)::bigint blocks, least(coalesce(won, 0), 2 * ceil(source_size / block)::bigint) won, block
  from goal g left join won on g.source is not distinct from won.source, seats),
plan2 as (select *, case when blocks > 0 then won // blocks else 0 end passes, case when blocks > 0 then won % blocks else 0 end extra from plan),
shards as (select source, extra, blocks, j, least(1024, blocks - j * 1024) votes from plan2, range(0, (blocks - 1) // 1024 + 1) r(j) where extra > 0),
sq as (select source, extra, blocks, j, s, votes::double / (2 * s + 1) q from shards, range(0, votes + 3) r(s)),
quota as (select source, blocks, j, count(*) won from (select * from sq qualify row_number() over (partition by source order by q desc, j, s) <= extra) group by all),
inside as (select source, j, won, i from quota, range(j * 1024, least((j + 1) * 1024, blocks)) r(i)),
chosen as (select source, i from inside qualify row_number() over (partition by source, j order by md5('42:' || coalesce(source, '-') || ':' || i), i) <= won),
extra as (select p.doc_id, sum(least((i + 1) * block, pos + size) - greatest(i * block, pos)) n
  from placed p, seats, chosen c where p.source is not distinct from c.source and size > 0 and i between pos // block and (pos + size - 1) // block group by 1)
select p.doc_id, p.size::bigint size, source_size::bigint source_size, target, (passes * p.size + coalesce(n, 0))::bigint taken
from placed p join plan2 g on p.source is not distinct from g.source left join extra e on e.doc_id = p.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """select doc_id, max(doc_id) over same keep_id, count(*) over same group_size, doc_id = max(doc_id) over same kept,
        sha256(coalesce(text, '')) text_sha256 from documents window same as (partition by coalesce(text, ''))""",
    "op9_sainte_lague_mixing": _MIX,
}
