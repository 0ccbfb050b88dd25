"""DuckDB SQL for the rows of the image analytics' queries, written on its own from what the operators are to give."""

from __future__ import annotations

import re

N = 10
FEATURES = [f"f{i}" for i in range(N)]


def each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in FEATURES)


FILES = """
files as (
  select doc_id, case when doc_id % 5 = 0 then 'Testing' else 'Training' end as split,
         'class_' || coalesce(lang, 'none') as class_name, printf('Img_%08d.png', doc_id) as file_name, coalesce(n_chars, 0) as score
  from documents
)
"""
MATRIX = f"m as (select vec_id, (label % 4)::int as label, {', '.join(f'embedding[{i + 1}]::double as {c}' for i, c in enumerate(FEATURES))} from embeddings)"
MOMENTS = f"s as (select {each('avg({c}) as mu_{c}')}, {each('stddev_pop({c}) as raw_{c}')} from m)"
SCALED = f"z as (select vec_id, label, {each('({c} - mu_{c}) / (case when raw_{c} = 0 then 1 else raw_{c} end) as {c}')} from m, s)"


def distance(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in FEATURES)


def lloyd(rounds: int) -> str:
    """Common table expressions: c0, the first four rows; r1, c1, ... the assignments and centers of each round."""
    parts = [MATRIX, MOMENTS, SCALED, f"c0 as (select (row_number() over (order by vec_id) - 1)::int as cluster, {each('{c}')} from (select * from z order by vec_id limit 4))"]
    for i in range(rounds + 1):
        parts.append(f"d{i} as (select z.vec_id, c{i}.cluster, {distance('z', f'c{i}')} as d2 from z, c{i})")
        parts.append(f"r{i} as (select vec_id, min_by(cluster, (d2, cluster)) as cluster, min(d2) as d2 from d{i} group by vec_id)")
        if i < rounds:
            parts.append(f"c{i + 1} as (select c{i}.cluster, {each('coalesce(avg(z.{c}), any_value(o.{c})) as {c}').replace('o.', f'c{i}.')} from c{i} left join r{i} using (cluster) left join z using (vec_id) group by c{i}.cluster)")
    return "with " + ",\n".join(parts)


THREE_ROUNDS = lloyd(3) + ",\nk as (select z.*, r3.cluster, r3.d2 from z join r3 using (vec_id))"
#: Rounds until the centers move less than 1e-5, 150 at most: a row for each round with its centers and inertia.
NEAREST = "list_position(list_transform(l.centers, lambda c: list_distance(p.x, c)), list_min(list_transform(l.centers, lambda c: list_distance(p.x, c))))"
CLUSTERED = f"""with recursive {MATRIX}, {MOMENTS}, {SCALED},
points as materialized (select vec_id, [{each('{c}')}] as x from z),
lloyd(iter, centers, shift, inertia) as (
  select 0, (select list(x order by vec_id) from (select * from points order by vec_id limit 4)), 1e9::double, null::double
  union all
  (
    select l.iter + 1, list_transform(range(1, 5), lambda k: coalesce(n.found[k], l.centers[k])),
           sqrt(list_sum(list_transform(range(1, 5), lambda k: coalesce(list_distance(n.found[k], l.centers[k]), 0) ** 2))), n.inertia
    from lloyd l, lateral (
      select list_transform(range(1, 5), lambda k: map_extract(map_from_entries(list((cluster, center))), k)[1]) as found, sum(squares - n * list_inner_product(center, center)) as inertia
      from (
        select cluster, [{', '.join(f'avg(x[{i + 1}])' for i in range(N))}] as center, count(*) as n, sum(list_inner_product(x, x)) as squares
        from (select p.x, {NEAREST} as cluster from points p) group by cluster
      )
    ) n
    where l.iter < 150 and l.shift >= 1e-5
  )
),
l as materialized (select centers from lloyd order by iter desc limit 1),
distances as (select p.vec_id, i::int as cluster, list_distance(p.x, l.centers[i + 1]) ** 2 as d2 from points p, l, range(4) t(i)),
k as materialized (select z.*, ({NEAREST} - 1)::int as cluster, list_distance(p.x, l.centers[{NEAREST}]) ** 2 as d2 from z join points p using (vec_id), l),
cont as (select cluster, label, count(*) as n from k group by 1, 2)"""
ALIGNED = (
    CLUSTERED
    + """,
ids as (select unnest([0, 1, 2, 3]) as i),
orders as (select a.i as a, b.i as b, c.i as c, d.i as d from ids a, ids b, ids c, ids d where a.i not in (b.i, c.i, d.i) and b.i not in (c.i, d.i) and c.i <> d.i),
hits as (select a, b, c, d, coalesce(sum(n) filter (where label = [a, b, c, d][cluster + 1]), 0) as hit from orders, cont group by a, b, c, d),
best as (select * from hits order by hit desc, a, b, c, d limit 1),
p as (select k.*, case when hit = 0 then k.cluster else [a, b, c, d][k.cluster + 1] end as pred from k, best),
cells as (select g.l as label, g.p as pred, count(p.vec_id) as n from (select x.i as l, y.i as p from ids x, ids y) g left join p on p.label = g.l and p.pred = g.p group by 1, 2)
"""
)
NAMED = CLUSTERED + ",\nnamed as (select cluster, 'class' || label as label, n from cont)"
SCORES = """
scores as (select l.doc_id, l.toxic, (coalesce(d.n_chars, 0) % 1000) / 1000.0::double as score from labels l join documents d using (doc_id) where l.toxic is not null)
"""
ROC = (
    "with "
    + SCORES
    + """,
steps as (select i, i / 199.0::double as threshold from range(200) t(i)),
curve as (
  select i, threshold,
         count(*) filter (where toxic <> 1 and score < threshold) / (count(*) filter (where toxic <> 1) + 1e-8) as fpr,
         count(*) filter (where toxic = 1 and score < threshold) / (count(*) filter (where toxic = 1) + 1e-8) as tpr
  from steps, scores group by i, threshold
)
"""
)

#: Pixels of the 8 x 8 images.
PIXELS = """
wide as (select vec_id as image_id, list_transform(embedding, lambda v: v::double) as e from embeddings),
flat as (select image_id, unnest(range(len(e))) as p, unnest(e) as e, list_min(e) as low, list_max(e) as high from wide),
px as (select image_id, (p // 8)::int as y, (p % 8)::int as x, case when high > low then floor(255 * (e - low) / (high - low)) else 0 end::int as v from flat)
"""
#: A coordinate beyond the border, folded back: without the edge, or with it.
REFLECT = "case when {a} < 0 then -({a}) when {a} > 7 then 14 - ({a}) else {a} end"
SYMMETRIC = "case when {a} < 0 then -({a}) - 1 when {a} > 7 then 15 - ({a}) else {a} end"


def blurred(fold: str, name: str = "blur") -> str:
    y, x = fold.format(a="(b.y + k.dy)"), fold.format(a="(b.x + k.dx)")
    return f"""
taps as (select a.d as dy, b.d as dx, exp(-(a.d * a.d + b.d * b.d) / (2 * 1.4::double * 1.4::double)) as g from (select unnest([-2, -1, 0, 1, 2]) as d) a, (select unnest([-2, -1, 0, 1, 2]) as d) b),
kernel as (select dy, dx, g / sum(g) over () as g from taps),
{name} as (
  select b.image_id, b.y, b.x, floor(least(greatest(sum(k.g * n.v), 0), 255) + 1e-9)::int as v
  from px b, kernel k, px n where n.image_id = b.image_id and n.y = ({y}) and n.x = ({x}) group by 1, 2, 3
)
"""


def equalised(source: str, name: str) -> str:
    return f"""
{name}_h as (select image_id, v, count(*) as n from {source} group by 1, 2),
{name}_c as (select image_id, v, sum(n) over (partition by image_id order by v) as cdf, min_by(n, v) over (partition by image_id) as low from {name}_h),
{name} as (select s.image_id, s.y, s.x, case when low = 64 then 0 else round_even((cdf - low) / (64 - low)::double * 255, 0) end::int as v from {source} s join {name}_c c on c.image_id = s.image_id and c.v = s.v)
"""


PREPARED = "with " + PIXELS + "," + blurred(REFLECT) + "," + equalised("blur", "eq") + """,
norm as (select image_id, y, x, (v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) as v from eq window w as (partition by image_id))
"""
OTSU = PREPARED + """,
levels as (select image_id, floor(v * 255)::int as t, count(*) as n from norm group by 1, 2),
full_levels as (select i.image_id, t.t, coalesce(l.n, 0) as n from (select distinct image_id from px) i, (select unnest(range(256))::int as t) t left join levels l on l.image_id = i.image_id and l.t = t.t),
runs as (select image_id, t, sum(n) over w as wb, sum(t * n) over w as sb, sum(t * n) over (partition by image_id) as s from full_levels window w as (partition by image_id order by t)),
spread as (select image_id, t, wb * (64 - wb) * (sb / wb - (s - sb) / (64 - wb)) * (sb / wb - (s - sb) / (64 - wb)) as var from runs where wb > 0 and wb < 64),
picked as (select image_id, min_by(t, (-round(var, 6), t)) as t from spread group by 1),
thresholds as (
  select n.image_id, coalesce(any_value(p.t), 0) / 255.0::double as otsu, quantile_cont(n.v, 0.82) as p82, min(n.v) as low, max(n.v) as high
  from norm n left join picked p on p.image_id = n.image_id group by n.image_id
)
"""
NEAR9 = "abs(n.y - b.y) <= 1 and abs(n.x - b.x) <= 1"


def morphology(source: str, name: str, erode: bool) -> str:
    """0/1 pixels; what is beyond the border counts as 0."""
    value = "case when count(*) filter (where n.v = 1) = 9 then 1 else 0 end" if erode else "max(n.v)"
    return f"{name} as (select b.image_id, b.y, b.x, {value}::int as v from {source} b join {source} n on n.image_id = b.image_id and {NEAR9} group by 1, 2, 3)"


def component(source: str, name: str) -> str:
    """The largest 4-connected component, the first by row order of equal ones; least labels walk 64 steps at most."""
    return f"""
{name}_set as (select image_id, y, x, (y * 8 + x)::int as id from {source} where v = 1),
{name}_edges as (select a.image_id, a.id as a, b.id as b from {name}_set a join {name}_set b on a.image_id = b.image_id and abs(a.y - b.y) + abs(a.x - b.x) <= 1),
{name}_reach as (
  select image_id, a, b from {name}_edges
  union
  select r.image_id, r.a, e.b from {name}_reach r join {name}_edges e on e.image_id = r.image_id and e.a = r.b
),
{name}_labels as (select image_id, a as id, min(b) as label from {name}_reach group by 1, 2),
{name}_sizes as (select image_id, label, count(*) as n from {name}_labels group by 1, 2),
{name}_best as (select image_id, min_by(label, (-n, label)) as label from {name}_sizes group by 1),
{name} as (
  select s.image_id, s.y, s.x, (l.label is not null)::int as v
  from {source} s left join ({name}_labels l join {name}_best b on b.image_id = l.image_id and b.label = l.label) on l.image_id = s.image_id and l.id = s.y * 8 + s.x
)
"""


def recursive(sql: str) -> str:
    """sql with recursion allowed; every other expression is computed once."""
    once = re.sub(r"(\w+) as \(", lambda m: m[0] if m[1] == "w" or m[1].endswith("_reach") else f"{m[1]} as materialized (", sql)
    return once.replace("with ", "with recursive ", 1)


BINARY = "bin as (select image_id, y, x, (v > 127)::int as v from px)"
SEGMENTED = recursive(OTSU + """,
mask as (select n.image_id, n.y, n.x, (n.v > greatest(t.otsu, 0.88 * t.p82))::int as v from norm n join thresholds t on t.image_id = n.image_id),
""" + morphology("mask", "er", True) + "," + component("er", "comp") + "," + morphology("comp", "di1", False) + "," + morphology("di1", "final", False))
COINS = "md5('42:' || doc_id)"


#: The lines of each conversation's turn, numbered from 1.
LINES = """with turns as (select conv_id, turn, role, string_split(coalesce(text, '') || {more}, chr(10)) as parts from conversations),
lines as (select conv_id, turn, unnest(range(1, len(parts) + 1))::int as line_no, unnest(parts) as line from turns)"""


def glcm(levels: str, name: str) -> str:
    """contrast, homogeneity, energy and correlation of {levels} (image_id, y, x, lv), means over four angles."""
    return f"""
{name}_a as (select unnest([0, 1, 2, 3]) as angle, unnest([0, 1, 1, 1]) as dy, unnest([1, 1, 0, -1]) as dx),
{name}_p as (select a.image_id, o.angle, a.lv as a, b.lv as b from {levels} a, {name}_a o, {levels} b where b.image_id = a.image_id and b.y = a.y + o.dy and b.x = a.x + o.dx),
{name}_both as (select image_id, angle, a, b from {name}_p union all select image_id, angle, b, a from {name}_p),
{name}_e as (select image_id, angle, sqrt(sum(n * n)) / sum(n) as energy from (select image_id, angle, a, b, count(*) as n from {name}_both group by all) group by 1, 2),
{name}_m as (select image_id, angle, avg(a) as middle, var_pop(a) as spread, avg(a * b) - avg(a) * avg(b) as together, avg((a - b) * (a - b)) as contrast, avg(1 / (1 + (a - b) * (a - b))) as homogeneity from {name}_both group by 1, 2),
{name} as (
  select i.image_id, avg(coalesce(m.contrast, 0)) as contrast, avg(coalesce(m.homogeneity, 0)) as homogeneity, avg(coalesce(e.energy, 0)) as energy,
         avg(case when m.spread is null or m.spread < 1e-12 then 1 else m.together / m.spread end) as correlation
  from (select distinct image_id, angle from {levels}, {name}_a) i left join {name}_m m on m.image_id = i.image_id and m.angle = i.angle left join {name}_e e on e.image_id = i.image_id and e.angle = i.angle group by 1
)
"""


CROSS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def borders(mask: str, name: str) -> str:
    """By set pixel of a mask: open, the number of its sides that aren't set."""
    near = " union all ".join(f"select {y} as dy, {x} as dx" for y, x in CROSS)
    return f"""
{name}_near as ({near}),
{name} as (
  select m.image_id, m.y, m.x, count(*) filter (where q.v is null or q.v = 0) as open
  from {mask} m cross join {name}_near o left join {mask} q on q.image_id = m.image_id and q.y = m.y + o.dy and q.x = m.x + o.dx where m.v = 1 group by 1, 2, 3
)
"""


def sobel(source: str, name: str) -> str:
    y, x = SYMMETRIC.format(a="(b.y + k.dy)"), SYMMETRIC.format(a="(b.x + k.dx)")
    return f"""
{name}_k(dy, dx, across, down) as (values (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 0, 0, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
{name} as (
  select b.image_id, b.y, b.x, sqrt(sum(k.across * n.v) ** 2 + sum(k.down * n.v) ** 2) as size
  from {source} b, {name}_k k, {source} n where n.image_id = b.image_id and n.y = ({y}) and n.x = ({x}) group by 1, 2, 3
)
"""


def region_sql() -> str:
    """Measures of the pixels above 127 and of the whole raw image, normalised."""
    n = "n8 as (select image_id, y, x, v as raw, (v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) as v from px window w as (partition by image_id))"
    weights = "list_position([5, 7, 15, 17, 25, 27], code) is not null then 1 when code in (21, 33) then sqrt(2) when code in (13, 23) then (1 + sqrt(2)) / 2 else 0"
    return "with " + PIXELS + "," + BINARY + "," + n + "," + borders("bin", "side") + f""",
edge as (select b.image_id, b.y, b.x, coalesce(s.open > 0, false)::int as v from bin b left join side s on s.image_id = b.image_id and s.y = b.y and s.x = b.x),
codes as (
  select e.image_id, e.y, e.x, sum(n.v * case abs(n.y - e.y) + abs(n.x - e.x) when 0 then 1 when 1 then 2 else 10 end)::int as code
  from edge e join edge n on n.image_id = e.image_id and abs(n.y - e.y) <= 1 and abs(n.x - e.x) <= 1 group by 1, 2, 3
),
rims as (select image_id, sum(case when {weights} end) as rim from codes group by 1),
sides as (select image_id, count(*) as area, count(*) filter (where open > 0) as border, sum(open) as exposed from side group by 1),
inside as (select n.image_id, n.v from n8 n join bin b on b.image_id = n.image_id and b.y = n.y and b.x = n.x where b.v = 1),
centered as (select image_id, v - avg(v) over (partition by image_id) as d, v from inside),
moments as (select image_id, avg(v) as mean, stddev_pop(v) + 1e-8 as std, avg(d ** 3) as m3, avg(d ** 4) as m4, count(*) as n from centered group by 1),
bins as (select image_id, count(*) as c, sum(count(*)) over (partition by image_id) as n from inside group by image_id, floor(v * 255)),
entropies as (select image_id, case when any_value(n) >= 4 then -sum(c / (n + 1e-8) * log2(c / (n + 1e-8) + 1e-8)) else 0 end as entropy from bins group by 1)
select m.image_id, round(m.mean, 6) as mean, round(m.std, 6) as std, round(m3 / std ** 3, 6) as skewness, round(m4 / std ** 4, 6) as kurtosis, round(entropy, 6) as local_entropy,
       round(border * border / (area + 1e-5), 6) as border_compactness, round(exposed * exposed / (area + 1e-8), 6) as edge_compactness, round(rim, 6) as perimeter
from moments m join sides s using (image_id) join rims using (image_id) join entropies using (image_id)
"""


def texture_sql() -> str:
    return "with " + PIXELS + """,
n8 as (select image_id, y, x, (v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) as v from px window w as (partition by image_id)),
l8 as (select image_id, y, x, floor(v * 255)::int as v from n8),
around(dy, dx, w) as (values (-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128)),
lbp as (
  select b.image_id, case when b.y in (0, 7) or b.x in (0, 7) then 0 else sum(case when n.v >= b.v then k.w else 0 end) end::int as code
  from l8 b, around k left join l8 n on n.image_id = b.image_id and n.y = b.y + k.dy and n.x = b.x + k.dx group by b.image_id, b.y, b.x, b.v
),
shares as (select image_id, code, count(*) / (64 + 1e-8) as p from lbp group by 1, 2),
middle as (select image_id, sum(code * p) as mean from shares group by 1),
codes as (select image_id, any_value(mean) as lbp_mean, sqrt(sum((code - mean) * (code - mean) * p)) as lbp_std, sum(p * p) as lbp_energy, -sum(p * log2(p + 1e-8)) as lbp_entropy from shares join middle using (image_id) group by 1),
lv as (select image_id, y, x, floor(v * 31)::int as lv from n8),""" + sobel("n8", "grad") + "," + glcm("lv", "co") + """
select c.image_id, round(lbp_mean, 6) as lbp_mean, round(lbp_std, 6) as lbp_std, round(lbp_energy, 6) as lbp_energy, round(lbp_entropy, 6) as lbp_entropy,
       round(g.mean, 6) as gradient_mean, round(g.std, 6) as gradient_std, round(g.top, 6) as gradient_max,
       round(contrast, 6) as glcm_contrast, round(homogeneity, 6) as glcm_homogeneity, round(energy, 6) as glcm_energy, round(correlation, 6) as glcm_correlation
from codes c join (select image_id, avg(size) as mean, stddev_pop(size) as std, max(size) as top from grad group by 1) g using (image_id) join co using (image_id)
"""


def d10_sql() -> str:
    return SEGMENTED + "," + borders("final", "side") + """,
d as (select image_id, y, x, v, v - avg(v) over (partition by image_id) as d from norm),
m as (select image_id, avg(v) as mean, stddev_pop(v) + 1e-8 as std, avg(d ** 3) as m3, avg(d ** 4) as m4 from d group by 1),
bins as (select image_id, count(*) / (64 + 1e-8) as p from norm group by image_id, least(floor(v * 32), 31)),
ent as (select image_id, -sum(p * log2(p + 1e-10)) as entropy from bins group by 1),
roi as (select n.image_id, sum(f.v) as area, coalesce(avg(n.v) filter (where f.v = 1), 0) as inside from norm n join final f on f.image_id = n.image_id and f.y = n.y and f.x = n.x group by 1),
open as (select image_id, sum(open) as exposed from side group by 1),
steps as (
  select a.image_id, avg(abs(a.v - b.v)) filter (where b.y = a.y + 1 and b.x = a.x) as down, avg(abs(a.v - b.v)) filter (where b.y = a.y and b.x = a.x + 1) as across, avg(abs(a.v - b.v)) filter (where b.y = a.y + 1 and b.x = a.x + 1) as diagonal
  from norm a join norm b on b.image_id = a.image_id and b.y - a.y in (0, 1) and b.x - a.x in (0, 1) group by 1
)
select m.image_id, round(mean, 6) as mean, round(std, 6) as std, round(m3 / std ** 3, 6) as skew, round(m4 / std ** 4 - 3, 6) as kurt, round(entropy, 6) as entropy,
       round(area / 64.0, 6)::double as tumor_area, round(inside, 6) as tumor_mean, round(coalesce(exposed, 0) * coalesce(exposed, 0) / (area + 1e-8), 6) as compactness,
       round((down + across) / 2, 6) as gradient, round(1 - diagonal, 6) as homogeneity
from m join ent using (image_id) join roi using (image_id) join steps using (image_id) left join open using (image_id)
"""


def f10_sql() -> str:
    return SEGMENTED + """,
areas as (select image_id, sum(v) as area from final group by 1),
mask2 as (select f.image_id, f.y, f.x, case when a.area = 0 then 1 else f.v end::int as v from final f join areas a on a.image_id = f.image_id),""" + borders("mask2", "side") + """,
bord as (select image_id, count(*) as area, count(*) filter (where open > 0) as border from side group by 1),
d as (select n.image_id, n.v, n.v - avg(n.v) over (partition by n.image_id) as d from norm n join mask2 f on f.image_id = n.image_id and f.y = n.y and f.x = n.x where f.v = 1),
m as (select image_id, avg(v) as mean, stddev_pop(v) + 1e-5 as std, avg(d ** 3) as m3, avg(d ** 4) as m4 from d group by 1),
box as (select image_id, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from mask2 where v = 1 group by 1),
crop as (select n.image_id, n.y, n.x, n.v from norm n join box b on b.image_id = n.image_id where n.y between y0 and y1 and n.x between x0 and x1),
lv as (select image_id, y, x, floor((v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) * 255)::int as lv from crop window w as (partition by image_id)),""" + glcm("lv", "co") + """
select m.image_id, round(mean, 6) as mean, round(std, 6) as std, round(area / 64.0, 6)::double as area_ratio, round(contrast, 6) as glcm_contrast, round(homogeneity, 6) as glcm_homogeneity, round(energy, 6) as glcm_energy,
       round(correlation, 6) as glcm_correlation, round(border * border / (area + 1e-5), 6) as compactness, round(m3 / std ** 3, 6) as skewness, round(m4 / std ** 4, 6) as kurtosis
from m join bord using (image_id) join co using (image_id)
"""


#: Steps of a tree whose heights are the sorted first components.
HEIGHTS = f"with {MATRIX}, merges as (select row_number() over (order by f0, vec_id)::int as step, f0 as height from m), gaps as (select step, height, height - lag(height) over (order by step) as gap from merges)"


def more_sql() -> dict[str, str]:
    prepared = recursive(PREPARED)
    return {
        "p6_correct": ALIGNED + " select vec_id, label, pred, pred = label as correct from p",
        "p7_constant_sigma": f"with {MATRIX} select vec_id, round(f0 - avg(f0) over (), 5) as f0_centered, 0.0::double as same, 3.5::double as mu, 1.0::double as sigma from m",
        "x3_four_decimals": f"with {MATRIX} select vec_id, printf('%.4f', f0) as text from m",
        "x5_half_even": "select vec_id, round_even(label + 0.5::double, 0) as whole from embeddings",
        "x7_clip": f"with {MATRIX} select vec_id, round(greatest(least(f0, 0.5), -0.5), 5) as f0 from m",
        "x8_distances": f"with {MATRIX}, e as (select [{each('{c}')}] as x from m order by vec_id limit 1) select vec_id, round(list_distance([{each('{c}')}], e.x) ** 2, 5) as squared, round(list_distance([{each('{c}')}], e.x), 5) as euclidean from m, e",
        "t2_probability_table": CLUSTERED + ", inv as (select vec_id, cluster, sqrt(d2) as d, 1 / (sqrt(d2) + 1e-8) as s from distances), val as (select *, s / sum(s) over (partition by vec_id) as value from inv) select vec_id, row_number() over (partition by vec_id order by value desc)::int as place, 'class' || cluster as class_name, round(value, 4) as value, round(value * 100, 2) as percent, round(d, 4) as distance from val",
        "t4_top_gaps": HEIGHTS + " select step, round(height, 5) as height, round(gap, 5) as gap from gaps where gap is not null order by gap desc, step limit 4",
        "t5_last_merges": HEIGHTS + " select step, round(height, 5) as height from merges order by step desc limit 60",
        "w4_cut_balanced": """
with recursive n as (select count(*) as n from embeddings),
walk(leaf, node) as (
  select i, i from n, range(n.n) t(i)
  union all
  select leaf, n.n + node // 2 from walk, n where node // 2 < n.n - 7
),
roots as (select leaf, max(node) as node from walk group by 1)
select leaf as id, (dense_rank() over (order by node) - 1)::int as cluster from roots""",
        "w5_gap_count": HEIGHTS + ", n as (select count(*) + 1 as n from merges), c as (select n - (step - 1) as k, gap, step, n from gaps, n) select max_by(k, (gap, step))::int as k from c where step > 1 and k >= 2 and k < n",
        "w6_cut_height": HEIGHTS + " select round((h[1] + h[2]) / 2, 5) as line from (select list(height order by height) as h from (select * from merges order by step desc limit 4))",
        "m1_axis_variances": f"with {MATRIX}, {MOMENTS}, {SCALED} select {N}::int as axes, round({each('var_pop({c})', ' + ')}, 4) as variance, 100.0::double as explained, 0.0::double as largest_covariance from z",
        "k3_normalize": prepared + "select image_id, y, x, floor(v * 255)::int as v from norm",
        "k11_brain_mask": recursive("with " + PIXELS + "," + blurred(SYMMETRIC) + "," + equalised("blur", "eq") + """,
norm as (select image_id, y, x, (v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) as v from eq window w as (partition by image_id)),
tissue as (select image_id, y, x, (v > 0.10)::int as v from norm),""" + ",".join(morphology(a, b, True) for a, b in (("tissue", "er1"), ("er1", "er2"), ("er2", "er3"))) + " select * from er3"),
        "k14_region_measures": region_sql(),
        "k16_texture": texture_sql(),
        "k18_features_d10": d10_sql(),
        "k19_features_f10": f10_sql(),
        "k21_png_features": d10_sql(),
        "s2_png_levels": "with " + PIXELS + " select image_id, y, x, v from px",
        "s3_png_classes": "select vec_id as image_id, 'Training' as split, 'class_' || label as class_name, label from embeddings",
        "k22_raw": "with " + PIXELS + " select image_id, y, x, v from px",
        "k22_equalized": prepared + "select * from eq",
        "k22_binary": SEGMENTED + " select * from mask",
        "k22_eroded": SEGMENTED + " select * from er",
        "k22_component": SEGMENTED + " select * from comp",
        "x12_overlay": "with " + PIXELS + """,
n8 as (select image_id, y, x, v as raw, floor((v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) * 255) as g from px window w as (partition by image_id))
select image_id, sum(case when raw > 127 then floor(g * 0.5 + 127.5) else g end)::bigint as red, sum(case when raw > 127 then floor(g * 0.5) else g end)::bigint as green, sum(case when raw > 127 then floor(g * 0.5) else g end)::bigint as blue from n8 group by 1""",
        "x13_boxes": SEGMENTED + " select image_id, coalesce(min(y) filter (where v = 1), 0)::int as y0, coalesce(min(x) filter (where v = 1), 0)::int as x0, coalesce(max(y + 1) filter (where v = 1), 0)::int as y1, coalesce(max(x + 1) filter (where v = 1), 0)::int as x1 from final group by 1",
    }


def oracle_sql() -> dict[str, str]:
    files = "with " + FILES
    metrics = "tp / (tp + fp + 1e-8) as precision, tp / (tp + fn + 1e-8) as recall"
    return {
        "cluster_report": ALIGNED + "select label, pred, n, round(n / (sum(n) over (partition by label) + 1e-8), 5) as share, round((select avg((pred = label)::int::double) from p), 5) as accuracy from cells",
        "a1_class_counts": files + "select c.class_id::int as class_id, c.class_name, count(f.doc_id) as n from (values (0, 'class_en'), (1, 'class_de'), (2, 'class_none'), (3, 'class_missing')) c(class_id, class_name) left join files f using (class_name) group by 1, 2",
        "a2_binary_class_counts": files + "select 'tumor' as class_name, count(*) filter (where class_name <> 'class_fr') as n from files union all select 'no_tumor', count(*) filter (where class_name = 'class_fr') from files",
        "a3_split_class_counts": files + "select split, class_name, count(*) as n from files group by rollup (split, class_name)",
        "p1_binary_label": files + "select doc_id, (class_name = 'class_fr')::int as binary from files",
        "p2_resolve_class_dirs": """
with found as (select distinct upper(source) || '_scans' as dir from documents where source is not null),
expected(class_name) as (values ('src1'), ('src19'), ('src7_scans_extra'), ('absent'))
select class_name, min(dir) as dir from expected left join found on contains(lower(dir), class_name) or contains(class_name, lower(dir)) group by 1""",
        "p5_only_class": files + "select doc_id, class_name from files where class_name = 'class_de'",
        "wd_first_per_class": files + "select class_name, file_name, nth::int as nth from (select *, row_number() over (partition by class_name order by lower(file_name), file_name) as nth from files) where nth <= 8",
        "t1_select_best": files + f"select doc_id, class_name, score, kept, nth::int as nth from (select *, row_number() over (partition by class_name order by kept desc, score desc, doc_id) as nth from (select *, substr({COINS}, 1, 8) >= '33333333' as kept from files)) where nth <= 50",
        "r2_stratified_split": files + f"select doc_id, class_name, case when nth <= greatest(1, floor(n * 0.2)) then 'test' else 'train' end as split from (select doc_id, class_name, row_number() over (partition by class_name order by {COINS}, doc_id) as nth, count(*) over (partition by class_name) as n from files)",
        "r3_unselected": files + "select doc_id from (select *, row_number() over (partition by class_name order by lower(file_name), file_name) as nth from files) where nth > 8",
        "s1_path_parts": files + "select doc_id, split, class_name, 'a b_' || file_name as file_name from files",
        "s6_cluster_summary": NAMED + "select count(*) as cluster_count, round(100 * sum(top) / sum(n), 2) as purity_percent, 'largest gap' as decision_method from (select cluster, max(n) as top, sum(n) as n from named group by 1)",
        "s7_accepted_uploads": "select page_id, url || ['.PNG', '.jpg', '.webp', '.gif', ''][(page_id % 5 + 1)::int] as path from pages where page_id % 5 < 3 or (page_id % 5 = 4 and regexp_matches(lower(url), '\\.(png|jpg|jpeg|bmp|jfif|webp)$'))",
        "a4_fit_zscore": "with " + MATRIX + " " + " union all ".join(f"select '{c}' as feature, round(avg({c}), 5) as mu, round(case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end, 5) as sigma from m" for c in FEATURES),
        "a4_lineitem_zscore": " union all ".join(f"select '{c}' as feature, round(avg({c}), 4) as mu, round(stddev_pop({c}), 4) as sigma from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "a5_apply_zscore": f"with {MATRIX}, {MOMENTS} select vec_id, {each('round(({c} - mu_{c}) / (raw_{c} + 1e-8), 5) as {c}')} from m, s",
        "a6_class_profile": f"with {MATRIX}, {MOMENTS}, {SCALED}, long as (unpivot z on {each('{c}')} into name feature value value), ends as (select min(value) as low, max(value) as high from long) select label, feature, round(avg((value - low) / (high - low + 1e-8)), 5) as value from long, ends group by 1, 2",
        "a20_covariance": "with " + MATRIX + " " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_pop({a}, {b}), 5) as cov from m" for a in FEATURES for b in FEATURES),
        "x11_percentiles": "with " + MATRIX + " select label, " + ", ".join(f"round(quantile_cont(f0, {p / 100}), 5) as p{p}" for p in (1, 82, 99)) + " from m group by 1",
        "m5_kmeans_given": lloyd(1) + " select vec_id, cluster, round(d2, 4) as d2 from r1",
        "a13_assignment": ALIGNED + "select 4 as clusters, round(max(hit) / count(*), 5) as accuracy from p, best",
        "m3_center_norms": CLUSTERED + f", mean as (select [{each('avg({c})')}] as x from z) select i::int as cluster, round(list_distance(l.centers[i + 1], mean.x) ** 2, 4) as square from l, mean, range(4) t(i)",
        "w1_ward_rounds": f"with {MATRIX}, {MOMENTS}, {SCALED} select count(*) - 1 as merges, round(count(*) * ({each('var_pop({c})', ' + ')}), 4) as spread, count(*) as points from z",
        "w2_single_parts": f"""with recursive {MATRIX}, {MOMENTS}, {SCALED},
near as (select a.vec_id as a, b.vec_id as b, {distance('a', 'b')} as d2 from z a join z b on a.vec_id <> b.vec_id where {distance('a', 'b')} <= 3),
heights as (select unnest([1.0, 1.4, 1.7])::double as height),
reach(height, a, b) as (select height, vec_id, vec_id from heights, z union select r.height, r.a, n.b from reach r join near n on n.a = r.b and n.d2 <= r.height * r.height)
select height, count(*) filter (where least = a) as parts from (select height, a, min(b) as least from reach group by 1, 2) group by height""",
        "m5_kmeans_three_rounds": THREE_ROUNDS + f" select cluster, count(*) as n, {each('round(avg({c}), 4) as {c}')} from k group by 1",
        "m9_convergence": CLUSTERED + " select iter::int as iter, round(inertia, 3) as inertia from lloyd where iter > 0",
        "a21_inertia": CLUSTERED + " select round(sum(d2), 3) as inertia from k",
        "x9_cluster_scores": CLUSTERED + ", inv as (select vec_id, cluster, d2, 1 / (sqrt(d2) + 1e-8) as s from distances) select vec_id, " + ", ".join(f"round(sum(s) filter (where cluster = {i}) / sum(s), 4) as s{i}" for i in range(4)) + ", round(sum(d2) filter (where cluster = 0) / (sum(d2) + 1e-8), 4) as pseudo from inv group by 1",
        "a7_confusion": ALIGNED + "select label, pred, n from cells",
        "a9_class_metrics": ALIGNED + f", t as (select i as label, sum(n) filter (where label = i and pred = i) as tp, sum(n) filter (where label <> i and pred = i) as fp, sum(n) filter (where label = i and pred <> i) as fn from ids, cells group by i), r as (select *, {metrics} from t) select label, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(precision, 5) as precision, round(recall, 5) as recall, round(2 * precision * recall / (precision + recall + 1e-8), 5) as f1 from r",
        "a11_contingency": CLUSTERED + " select * from cont",
        "a12_align": ALIGNED + "select count(*) as n, round(max(hit) / count(*), 5) as accuracy from p, best",
        "a14_adjusted_rand": CLUSTERED + ", x as (select (select sum(n * (n - 1) / 2) from cont) as t, (select sum(s * (s - 1) / 2) from (select sum(n) as s from cont group by cluster)) as a, (select sum(s * (s - 1) / 2) from (select sum(n) as s from cont group by label)) as b, (select sum(n) * (sum(n) - 1) / 2 from cont) as all_pairs) select round((t - a * b / all_pairs) / ((a + b) / 2 - a * b / all_pairs), 5) as ari from x",
        "a15_dominant_class": NAMED + " select cluster, label as dominant from (select *, row_number() over (partition by cluster order by n desc, label desc) as r from named) where r = 1",
        "a16_purity": NAMED + " select round(sum(top) / sum(n), 5) as purity from (select cluster, max(n) as top, sum(n) as n from named group by 1)",
        "a17_cluster_cards": NAMED + " select cluster as cluster_id, 'Cluster ' || (cluster + 1) as label, sum(n)::bigint as count, max_by(label, (n, label)) as mapped_class, string_agg(label || '=' || n, ',' order by label) as distribution from named group by cluster",
        "a18_cluster_precision": CLUSTERED + ", g as (select unnest([0, 1, 2, 3])::int as cluster) select cluster, cluster as assigned, coalesce(sum(n) filter (where label = cluster), 0)::bigint as correct, coalesce(sum(n), 0)::bigint as total, round(coalesce(100.0 * coalesce(sum(n) filter (where label = cluster), 0) / sum(n), 0), 5)::double as pct from g left join cont using (cluster) group by cluster",
        "a19_silhouette": f"with {MATRIX}, d as (select a.vec_id, a.label as own, b.label as other, sqrt({distance('a', 'b')}) as d, a.vec_id = b.vec_id as self from m a, m b), g as (select vec_id, own, other, sum(d) as d, count(*) as n from d group by 1, 2, 3), s as (select vec_id, own as label, max(case when own = other then n end) as size, max(case when own = other and n > 1 then d / (n - 1) end) as a, min(case when own <> other then d / n end) as b from g group by 1, 2) select vec_id, label, round(case when size = 1 or b is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end, 5) as silhouette from s",
        "a19_silhouette_squared": f"with {MATRIX}, d as (select a.vec_id, a.label as own, b.label as other, {distance('a', 'b')} as d, a.vec_id = b.vec_id as self from m a, m b), g as (select vec_id, own, other, sum(d) as d, count(*) as n from d group by 1, 2, 3), s as (select vec_id, own as label, max(case when own = other then n end) as size, max(case when own = other and n > 1 then d / (n - 1) end) as a, min(case when own <> other then d / n end) as b from g group by 1, 2) select vec_id, label, round(case when size = 1 or b is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end, 5) as silhouette from s",
        "m13_evaluate_models": f"with {SCORES}, models(model, t) as (values ('low', 0.2), ('middle', 0.5), ('high', 0.8)), p as (select model, toxic as label, (score >= t)::int as pred from scores, models), c as (select model, avg((label = pred)::int::double) as accuracy, count(*) filter (where label = 0 and pred = 0) as tp, count(*) filter (where label <> 0 and pred = 0) as fp, count(*) filter (where label = 0 and pred <> 0) as fn from p group by 1), r as (select *, {metrics} from c) select model, round(accuracy, 5) as accuracy, round(precision, 5) as precision, round(recall, 5) as recall, round(2 * precision * recall / (precision + recall + 1e-8), 5) as f1, accuracy = max(accuracy) over () as best from r",
        "m14_roc": ROC + "select round(threshold, 5) as threshold, round(fpr, 5) as fpr, round(tpr, 5) as tpr from curve",
        "m14_auc": ROC + "select round(sum((fpr - px) * (tpr + py) / 2), 5) as auc from (select fpr, tpr, lag(fpr) over (order by fpr, tpr) as px, lag(tpr) over (order by fpr, tpr) as py from curve)",
        "k1_blur": "with " + PIXELS + "," + blurred(REFLECT) + "select * from blur",
        "k1_symmetric_blur": "with " + PIXELS + "," + blurred(SYMMETRIC) + "select * from blur",
        "k2_equalize": "with " + PIXELS + "," + equalised("px", "eq") + "select * from eq",
        "k5_thresholds": OTSU + "select image_id, round(otsu, 5) as otsu, round(p82, 5) as p82, round(low, 5) as low, round(high, 5) as high from thresholds",
        "k6_erode": "with " + PIXELS + "," + BINARY + "," + morphology("bin", "er", True) + " select * from er",
        "k6_dilate": "with " + PIXELS + "," + BINARY + "," + morphology("bin", "di", False) + " select * from di",
        "k7_largest_component": recursive("with " + PIXELS + "," + BINARY + "," + component("bin", "comp") + " select * from comp"),
        "k8_segment": SEGMENTED + " select * from final",
        "k9_quality": "with " + PIXELS + f""",
lap as (
  select b.image_id, b.y, b.x, any_value(b.v) as v, sum(k.w * n.v)::double as l
  from px b, (values (0, 0, -4), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1)) k(dy, dx, w), px n
  where n.image_id = b.image_id and n.y = ({SYMMETRIC.format(a='(b.y + k.dy)')}) and n.x = ({SYMMETRIC.format(a='(b.x + k.dx)')}) group by 1, 2, 3
)
select image_id, round(var_pop(l) + stddev_pop(v) - abs(avg(v) - 128), 5) as quality from lap group by 1""",
        "k15_lbp_codes": "with " + PIXELS + """,
n8 as (select image_id, y, x, floor((v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) * 255)::int as v from px window w as (partition by image_id))
select b.image_id, b.y, b.x, case when b.y in (0, 7) or b.x in (0, 7) then 0 else sum(case when n.v >= b.v then k.w else 0 end) end::int as v
from n8 b, (values (-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128)) k(dy, dx, w)
left join n8 n on n.image_id = b.image_id and n.y = b.y + k.dy and n.x = b.x + k.dx group by b.image_id, b.y, b.x, b.v""",
        "x1_log_accuracy": LINES.format(more="case when turn % 2 = 0 then ' Accuracy globale : ' || turn || '.5%' else ' ACCURACY= 71.25%' end") + r"""
select conv_id, turn, line_no, coalesce(try_cast(nullif(regexp_extract(line, 'Accuracy globale\s*:\s*([0-9.]+)%', 1), '') as double), try_cast(nullif(regexp_extract(line, '(?i)accuracy=\s*([0-9.]+)%', 1), '') as double)) as accuracy from lines""",
        "x2_report_lines": LINES.format(more="chr(10) || '  Classe ' || role || chr(10) || chr(10) || ' ' || chr(10) || '... ' || role || chr(10) || 'Convergence ' || turn || chr(10)") + r""",
t as (select conv_id, turn, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as report from lines),
u as (select *, lower(report) as low from t),
kept as (
  select conv_id, turn, line_no, report from u
  where not (contains(low, 'analyse images') or starts_with(report, '...') or contains(low, 'pipeline termin') or contains(low, 'fichiers génér') or contains(low, 'sauvegard'))
  and (contains(report, 'ETAPE') or contains(report, 'ÉTAPE') or contains(report, 'Classification MRI') or contains(report, 'Segmentation avanc')
       or contains(report, 'Convergence') or contains(low, 'inertie=') or contains(report, 'images ×') or contains(report, 'Accuracy globale')
       or regexp_matches(report, '^(Classe|tumor|no_tumor|Cluster K-Means|Cluster 0|Cluster 1|-+$)') or report = '')
),
k as (
  select *, lag(report) over w as before, max((report <> '')::int) over (partition by conv_id, turn order by line_no rows between 1 following and unbounded following) as after
  from kept window w as (partition by conv_id, turn order by line_no)
)
select conv_id, turn, line_no, report from k where report <> '' or (before <> '' and after = 1)""",
        **more_sql(),
    }
