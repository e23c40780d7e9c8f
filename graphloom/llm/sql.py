"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations


def code_compression_sql(rounds: int = 4) -> str:
    """Lloyd's rounds unrolled: b are the codebooks, a the assignments (distance * 256 + entry), in whole numbers."""
    nearest = "select rid, p, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::bigint * 256 + e) m from parts join b{0} using (p) group by rid, p"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized ({nearest.format(r)})")
        if r < rounds:
            steps.append(
                f"""s{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) c from (select p, m % 256 e, i, sum(x[i]::bigint)::bigint s, count(*) n
                from a{r} join parts using (rid, p), range(1, 1 + (select w from width)) t(i) group by all) group by p, e),
            b{r + 1} as materialized (select p, e, coalesce(s{r}.c::double[], b{r}.c) c from b{r} left join s{r} using (p, e))"""
            )
    return f"""
with kept as materialized (select row_number() over (order by vec_id nulls last) rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
width as materialized (select coalesce(max(len(v)), 0) // 4 w from kept),
parts as materialized (select rid, p, v[p * w + 1 : (p + 1) * w] x from kept, width, range(4) t(p)),
b0 as materialized (select p, rid - 1 e, x c from parts where rid <= 256),
{", ".join(steps)},
sha as (select sha256(string_agg(x::bigint::varchar, ',' order by p, e, i)) codebooks_sha256 from (select p, e, unnest(c) x, generate_subscripts(c, 1) i from b{rounds})),
coded as (select rid, string_agg(printf('%02x', m % 256), '' order by p) code, sum(m // 256)::bigint error from a{rounds} group by rid)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from kept join coded using (rid), sha
"""


#: crc32 by bits: a step below 256 is a byte, which is added; 256 shifts.
SPELLING_SQL = r"""
with runs as (select doc_id, run, count(*) k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) run from documents) group by all),
hashed as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch:
      case when unicode(ch) < 128 then [unicode(ch)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]
      else [192 + unicode(ch) // 64, 256, 256, 256, 256, 256, 256, 256, 256, 128 + unicode(ch) % 64, 256, 256, 256, 256, 256, 256, 256, 256] end))),
    lambda c, s: case when s < 256 then xor(c, s) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) h from runs),
words as materialized (select word, sum(k)::bigint n from (select k, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end word from hashed)
    where length(word) >= 5 group by word having sum(k) >= 3),
cut as materialized (select word, i, left(word, i) || substr(word, i + 2) rest from words, range(0, length(word)) t(i)),
pairs as (select a.word, b.word other from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word from cut a join words b on a.rest = b.word
    union select b.word, a.word from cut a join words b on a.rest = b.word),
best as (select pairs.word, count(*) n_near, arg_min(other, (-m.n, other)) form, max(m.n) form_n from pairs join words m on m.word = other group by pairs.word),
forms as materialized (select word, n, coalesce(n_near, 0) n_near, case when form_n >= 2 * n then form end form, case when form_n >= 2 * n then form_n end form_n from words left join best using (word)),
chain as (with recursive c(word, root, further) as (select word, word, form from forms union all select c.word, forms.word, forms.form from c join forms on forms.word = c.further) select word, root from c where further is null)
select word, n, n_near, form, form_n, root from forms join chain using (word)
"""
