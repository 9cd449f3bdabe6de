"""The catalogue's queries in DuckDB's SQL, written independently of the Spark plans."""

from __future__ import annotations

PX = """dim AS (SELECT s_suppkey AS image_id, CAST(s_suppkey % 10 AS INT) AS kind, CAST(48 + s_suppkey % 17 AS INT) AS h, CAST(8 + s_suppkey % 8 AS INT) AS rad FROM supplier),
g AS (SELECT d.*, CAST(ys.i AS INT) AS y, CAST(xs.i AS INT) AS x, (xs.i-32)*(xs.i-32) + (ys.i-24)*(ys.i-24) AS d2 FROM dim d CROSS JOIN (SELECT i FROM range(64) t(i)) ys CROSS JOIN (SELECT i FROM range(64) t(i)) xs WHERE ys.i < d.h),
nn AS (SELECT g.*, (x*31 + y*17 + image_id*7) % 5 - 2 AS nz, (x*x*7 + y*y*13 + x*y*(image_id%31+1)) % 256 AS rnd, CASE WHEN kind > 1 AND d2 <= rad*rad THEN 1 ELSE 0 END AS obj FROM g),
px AS (SELECT image_id, y, x, h,
  CAST(CASE kind WHEN 0 THEN 100 WHEN 1 THEN rnd ELSE nz + CASE obj WHEN 1 THEN 240 ELSE 40 END END AS INT) AS r,
  CAST(CASE kind WHEN 0 THEN 100 WHEN 1 THEN (rnd*3)%256 ELSE nz + CASE obj WHEN 1 THEN 220 ELSE 90 END END AS INT) AS g,
  CAST(CASE kind WHEN 0 THEN 100 WHEN 1 THEN (rnd*5)%256 ELSE nz + CASE obj WHEN 1 THEN 20 ELSE 160 END END AS INT) AS b,
  CASE WHEN kind > 1 AND d2 <= (rad+3)*(rad+3) THEN 1 ELSE 0 END AS roi FROM nn)"""
PAD = PX + """,
pad AS (SELECT p.image_id, q.i AS y, p.x, p.r, p.g, p.b, p.h, CASE WHEN q.i < p.h THEN p.roi ELSE 0 END AS roi FROM px p JOIN (SELECT i FROM range(64) t(i)) q ON p.y = least(q.i, p.h - 1))"""
BLOCK = PAD + """,
block AS (SELECT image_id, l.i AS level, y >> l.i AS by_, x >> l.i AS bx, count(*) AS n, max(h) AS h,
  sum(r) AS sum_r, sum(g) AS sum_g, sum(b) AS sum_b, sum(r*r) AS sq_r, sum(g*g) AS sq_g, sum(b*b) AS sq_b,
  min(r) AS min_r, min(g) AS min_g, min(b) AS min_b, max(r) AS max_r, max(g) AS max_g, max(b) AS max_b, max(roi) AS roi_any
  FROM pad CROSS JOIN (SELECT CAST(i AS INT) AS i FROM range(7) t(i)) l GROUP BY ALL)"""
_RANGE_STOP = "(level = 0 OR (roi_any = 0 AND greatest(max_r-min_r, max_g-min_g, max_b-min_b) <= 12))"


def _over(t: str) -> str:
    return "(" + " OR ".join(f"n*sq_{k} - sum_{k}*sum_{k} > {t}*n*n" for k in "rgb") + ")"


_VARIANCE_STOP = f"(level = 0 OR (roi_any = 0 AND NOT ({_over('12')} AND ((1 << level) > 2 OR {_over('36')}))))"


def leaf(stop: str = _RANGE_STOP) -> str:
    return BLOCK + f""",
stop AS (SELECT * FROM block WHERE {stop}),
of_px AS (SELECT p.image_id, p.y, p.x, max(s.level) AS level FROM (SELECT image_id, y, x FROM pad) p JOIN stop s ON s.image_id = p.image_id AND s.by_ = p.y >> s.level AND s.bx = p.x >> s.level GROUP BY ALL),
leaf AS (SELECT s.*, s.bx << s.level AS x, s.by_ << s.level AS y, least(1 << s.level, 64 - (s.bx << s.level)) AS w, least(1 << s.level, s.h - (s.by_ << s.level)) AS hh, sum_r/n AS r, sum_g/n AS g, sum_b/n AS b
  FROM stop s JOIN (SELECT DISTINCT image_id, level, y >> level AS by_, x >> level AS bx FROM of_px) o USING (image_id, level, by_, bx) WHERE (s.by_ << s.level) < s.h)"""


LEAF, LEAF_VARIANCE = leaf(), leaf(_VARIANCE_STOP)
BAND = LEAF + """,
band AS (SELECT *, CASE WHEN lag(x + w) OVER o = x THEN 0 ELSE 1 END AS gap, row_number() OVER o AS place FROM leaf WHERE roi_any = 0 WINDOW o AS (PARTITION BY image_id, y, hh ORDER BY x)),
island AS (SELECT *, sum(gap) OVER (PARTITION BY image_id, y, hh ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM band)"""
# pairs (i, j): spans of a band that end at i and begin at j; ok is whether the span keeps the tolerance, good whether no shorter one fails
ROWS = BAND + """,
pair AS (SELECT i.image_id, i.y, i.hh, i.place AS i, j.place AS j, j.w*j.hh AS a, j.r*j.w*j.hh AS ar, j.g*j.w*j.hh AS ag, j.b*j.w*j.hh AS ab, j.min_r, j.min_g, j.min_b, j.max_r, j.max_g, j.max_b
  FROM island i JOIN island j ON i.image_id = j.image_id AND i.y = j.y AND i.hh = j.hh AND i.island = j.island AND j.place <= i.place AND j.place > i.place - 64),
span AS (SELECT image_id, y, hh, i, j, sum(a) OVER o AS a, sum(ar) OVER o AS ar, sum(ag) OVER o AS ag, sum(ab) OVER o AS ab, min(min_r) OVER o AS lr, min(min_g) OVER o AS lg, min(min_b) OVER o AS lb, max(max_r) OVER o AS ur, max(max_g) OVER o AS ug, max(max_b) OVER o AS ub
  FROM pair WINDOW o AS (PARTITION BY image_id, y, hh, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING)),
checked AS (SELECT *, greatest(abs(ur-ar/a), abs(ug-ag/a), abs(ub-ab/a), abs(lr-ar/a), abs(lg-ag/a), abs(lb-ab/a)) <= 12 AS ok FROM span),
good AS (SELECT *, bool_and(ok) OVER (PARTITION BY image_id, y, hh, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS good FROM checked),
low AS (SELECT image_id, y, hh, CAST(i AS INT) AS i, CAST(coalesce(min(j) FILTER (good), max(i)) AS INT) AS lo FROM good GROUP BY image_id, y, hh, i),
dp AS (SELECT image_id, y, hh, 0 AS i, [0] AS best, CAST([] AS INT[]) AS back FROM low WHERE i = 1
  UNION ALL SELECT d.image_id, d.y, d.hh, l.i, list_append(d.best, list_min(d.best[l.lo:l.i]) + 1),
    list_append(d.back, CAST(l.i - list_position(list_reverse(d.best[l.lo:l.i]), list_min(d.best[l.lo:l.i])) AS INT))
  FROM dp d JOIN low l ON l.image_id = d.image_id AND l.y = d.y AND l.hh = d.hh AND l.i = d.i + 1),
last AS (SELECT image_id, y, hh, max(i) AS n, max_by(best, i) AS best, max_by(back, i) AS back FROM dp GROUP BY ALL),
cuts AS (SELECT image_id, y, hh, n AS upto, back[n] AS after, back FROM last
  UNION ALL SELECT image_id, y, hh, after, back[after], back FROM cuts WHERE after > 0),
row_tile AS (SELECT c.image_id, c.y, c.hh, min(b.x) AS x, sum(b.w) AS w, count(*) AS merged_from, sum(b.r*b.w*b.hh)/sum(b.w*b.hh) AS r, sum(b.g*b.w*b.hh)/sum(b.w*b.hh) AS g, sum(b.b*b.w*b.hh)/sum(b.w*b.hh) AS b
  FROM cuts c JOIN island b ON b.image_id = c.image_id AND b.y = c.y AND b.hh = c.hh AND b.place > c.after AND b.place <= c.upto GROUP BY c.image_id, c.y, c.hh, c.upto)"""
ENTRIES = "entry AS (SELECT s_suppkey AS id, 'img_' || s_suppkey || '.png' AS name, CAST(64 AS INT) AS width, CAST(48 + s_suppkey % 17 AS INT) AS height, CAST(100 + (s_suppkey * 37) % 900 AS BIGINT) AS length FROM supplier)"
FILES = """f AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '/data/a/' WHEN 1 THEN '/data/b.x/' ELSE '/data/' END || 'pic_' || (s_suppkey // 2) || CASE s_suppkey % 7 WHEN 0 THEN '.GIF' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '' WHEN 4 THEN '.tar.webp' ELSE '.png' END AS path,
  (s_suppkey * 13) % 11 AS length, s_suppkey % 17 <> 5 AS decodable, CASE WHEN s_suppkey % 13 = 4 THEN 16 ELSE 8 END AS bits, CASE s_suppkey % 19 WHEN 3 THEN 1 WHEN 6 THEN 4 ELSE 3 END AS channels, CASE WHEN s_suppkey % 23 = 7 THEN 4097 ELSE 64 END AS height, 32 AS width FROM supplier),
base AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS base FROM f)"""
REASON = """CASE WHEN ext NOT IN ('png','jpg','jpeg','bmp','tif','tiff','webp') THEN 'unsupported extension' WHEN length <= 0 THEN 'unreadable or empty file' WHEN NOT decodable THEN 'not a decodable image'
  WHEN bits <> 8 THEN 'not 8-bit' WHEN channels = 1 THEN 'grayscale' WHEN channels <> 3 THEN 'not 3 channels' WHEN greatest(height, width) > 4096 THEN 'larger than 4096' WHEN least(height, width) < 1 THEN 'no pixels' ELSE 'valid' END"""
BYTES = """pairs AS (SELECT unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')) AS p FROM documents),
bytes AS (SELECT (strpos('0123456789ABCDEF', p[1:1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2:2]) - 1 AS byte FROM pairs WHERE p <> '')"""
# one step joins the two lightest symbols; what it weighs is added to the number of coded bits
HUFFMAN = BYTES.replace("AS p FROM documents", "AS p, doc_id FROM documents").replace("AS byte FROM pairs", "AS byte, doc_id FROM pairs") + """,
counted AS (SELECT doc_id, byte, count(*) AS n FROM bytes GROUP BY ALL),
doc AS (SELECT doc_id, list_sort(list(n)) AS l, count(*) AS kinds, sum(n) AS size FROM counted GROUP BY doc_id),
step AS (SELECT doc_id, l, 0::BIGINT AS bits FROM doc UNION ALL SELECT doc_id, list_sort(list_append(l[3:], l[1] + l[2])), (bits + l[1] + l[2])::BIGINT FROM step WHERE len(l) > 1),
coded AS (SELECT doc_id, kinds, size, CASE WHEN kinds = 1 THEN size ELSE bits END AS bits FROM step JOIN doc USING (doc_id) WHERE len(step.l) = 1)"""
# a column's tiles are merged from top to bottom; t numbers the merged ones
COLUMNS = ROWS.replace("count(*) AS merged_from,", "count(*) AS merged_from, " + ", ".join(f"min(b.min_{k}) AS l{k}, max(b.max_{k}) AS u{k}" for k in "rgb") + ",") + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, w ORDER BY y) AS p FROM row_tile),
grow AS (SELECT image_id, x, w, p, 1 AS t, y, hh, merged_from, r, g, b, lr, lg, lb, ur, ug, ub FROM placed WHERE p = 1
  UNION ALL SELECT image_id, x, w, p, CASE WHEN ok THEN t ELSE t + 1 END, CASE WHEN ok THEN y ELSE y2 END, CASE WHEN ok THEN hh + h2 ELSE h2 END, CASE WHEN ok THEN merged_from + m2 ELSE m2 END,
    """ + ", ".join(f"CASE WHEN ok THEN n{k} ELSE {k}2 END" for k in "rgb") + ", " + ", ".join(f"CASE WHEN ok THEN least(l{k}, l{k}2) ELSE l{k}2 END" for k in "rgb") + ", " + ", ".join(f"CASE WHEN ok THEN greatest(u{k}, u{k}2) ELSE u{k}2 END" for k in "rgb") + """
  FROM (SELECT *, y + hh = y2 AND greatest(""" + ", ".join(f"abs(greatest(u{k}, u{k}2) - n{k}), abs(least(l{k}, l{k}2) - n{k})" for k in "rgb") + """) <= 12 AS ok
    FROM (SELECT s.image_id, s.x, s.w, c.p, s.t, s.y, s.hh, s.merged_from, """ + ", ".join(f"s.{k}, s.l{k}, s.u{k}, c.{k} AS {k}2, c.l{k} AS l{k}2, c.u{k} AS u{k}2, (s.{k} * s.hh + c.{k} * c.hh) / (s.hh + c.hh) AS n{k}" for k in "rgb") + """, c.y AS y2, c.hh AS h2, c.merged_from AS m2
      FROM grow s JOIN placed c ON c.image_id = s.image_id AND c.x = s.x AND c.w = s.w AND c.p = s.p + 1) j) jj),
merged AS (SELECT image_id, x, w, max_by(y, p) AS y, max_by(hh, p) AS h, max_by(merged_from, p) AS merged_from, max_by(r, p) AS r, max_by(g, p) AS g, max_by(b, p) AS b FROM grow GROUP BY image_id, x, w, t)"""
VERIFY = LEAF + """,
off AS (SELECT p.image_id, p.y, p.x, p.roi, greatest(abs(p.r - round_even(f.r, 0)), abs(p.g - round_even(f.g, 0)), abs(p.b - round_even(f.b, 0))) AS err FROM px p JOIN of_px o USING (image_id, y, x) JOIN leaf f ON f.image_id = o.image_id AND f.level = o.level AND f.by_ = o.y >> o.level AND f.bx = o.x >> o.level),
rowsv AS (SELECT image_id, count_if(roi = 1) AS roi_pixels, count_if(roi = 1 AND err = 0) AS roi_exact_pixels, count_if(roi = 0) AS background_pixels, max(err) FILTER (roi = 0) AS max_err, bool_and(err = 0) AS full_exact FROM off GROUP BY image_id)"""


def q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


B = "CAST({} AS BIGINT)"
big = lambda e, name: f"CAST({e} AS BIGINT) AS {name}"

ORACLE_SQL = {
    "raster_summary": q(PX, f"SELECT image_id, {big('count(*)', 'n_px')}, {big('max(y)+1', 'height')}, {big('count(*)*3', 'raw_bytes')}, {big('sum(r)', 'sum_r')}, {big('sum(g)', 'sum_g')}, {big('sum(b)', 'sum_b')}, {big('sum(roi)', 'n_roi')} FROM px GROUP BY image_id"),
    "raster_pad": q(PAD, f"SELECT image_id, {big('count(*)', 'n_px')}, {big('sum(r*(y+1)+x)', 'weighted')}, {big('sum(roi)', 'n_roi')} FROM pad GROUP BY image_id"),
    "roi_coverage": q(PX, f"SELECT image_id, round(avg(roi), 9) AS coverage, {big('sum(roi)', 'n_roi')} FROM px GROUP BY image_id"),
    "roi_percentile_threshold": q(PX, f", t AS (SELECT image_id, quantile_cont(CAST(r AS DOUBLE), 0.9) AS t, min(r) AS lo, max(r) AS hi FROM px GROUP BY image_id) SELECT image_id, round(any_value(t), 6) AS threshold, {big('sum(CASE WHEN hi - lo <= 1e-6 THEN 0 WHEN t <= lo + 1e-6 THEN CAST(r > lo + 1e-6 AS INT) ELSE CAST(r >= t AS INT) END)', 'n_mask')} FROM px JOIN t USING (image_id) GROUP BY image_id"),
    "roi_minmax_normalize": q(PX, f", t AS (SELECT image_id, min(r) AS lo, max(r) AS hi FROM px GROUP BY image_id) SELECT image_id, round(sum(CASE WHEN hi - lo <= 1e-6 THEN 0.0 ELSE (r - lo) / (hi - lo) END), 4) AS total, {big('count(*)', 'n')} FROM px JOIN t USING (image_id) GROUP BY image_id"),
    "roi_hole_fill": q(PX + """,
ring AS (SELECT image_id, y, x, h, CASE WHEN d2 BETWEEN rad*rad AND (rad+3)*(rad+3) THEN 1 ELSE 0 END AS roi FROM g),
reach(image_id, y, x) AS (SELECT image_id, y, x FROM ring WHERE roi = 0 AND (y = 0 OR x = 0 OR y = h - 1 OR x = 63)
  UNION SELECT n.image_id, n.y, n.x FROM reach c JOIN ring n ON n.image_id = c.image_id AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.roi = 0)""", f"SELECT image_id, {big('count(*)', 'n_px')}, {big('sum(r.roi)', 'n_roi')}, {big('count(*) - count(c.image_id)', 'n_filled')} FROM ring r LEFT JOIN reach c USING (image_id, y, x) GROUP BY image_id", True),
    "block_stats_pyramid": q(BLOCK, f"SELECT image_id, {big('level', 'level')}, {big('count(*)', 'n_blocks')}, {big('sum(n)', 'n_px')}, {big('sum(sum_r + 3*sum_g + 5*sum_b)', 'sums')}, {big('sum(sq_r + sq_g + sq_b)', 'squares')}, {big('sum(roi_any)', 'roi_blocks')}, {big('max(greatest(n*sq_r-sum_r*sum_r, n*sq_g-sum_g*sum_g, n*sq_b-sum_b*sum_b))', 'max_var_num')} FROM block GROUP BY image_id, level"),
    "block_range_pyramid": q(BLOCK, f"SELECT image_id, {big('level', 'level')}, {big('sum(greatest(max_r-min_r, max_g-min_g, max_b-min_b))', 'range_sum')}, {big('max(greatest(max_r-min_r, max_g-min_g, max_b-min_b))', 'range_max')} FROM block GROUP BY image_id, level"),
    "quadtree_leaves_range": q(LEAF, f"SELECT image_id, {big('level', 'level')}, {big('count(*)', 'n_leaves')}, {big('sum(w*hh)', 'area')}, {big('sum(roi_any)', 'n_roi')}, {big('sum(sum_r)', 'sum_r')} FROM leaf GROUP BY image_id, level"),
    "quadtree_leaves_variance": q(LEAF_VARIANCE, f"SELECT image_id, {big('level', 'level')}, {big('count(*)', 'n_leaves')}, {big('sum(w*hh)', 'area')}, {big('sum(roi_any)', 'n_roi')}, {big('sum(sum_r)', 'sum_r')} FROM leaf GROUP BY image_id, level"),
    "quadtree_morton_order": q(LEAF, ", m AS (SELECT image_id, x, y, w, (" + " + ".join(f"(((x >> {i}) & 1) << {2 * i}) + (((y >> {i}) & 1) << {2 * i + 1})" for i in range(6)) + f") AS code FROM leaf) SELECT image_id, {big('x', 'x')}, {big('y', 'y')}, {big('w', 'w')}, {big('code', 'code')}, {big('row_number() OVER (PARTITION BY image_id ORDER BY code)', 'place')} FROM m"),
    "quadtree_reconstruct_error": q(LEAF, f", err AS (SELECT p.*, greatest(abs(p.r-f.r), abs(p.g-f.g), abs(p.b-f.b)) AS e, p.r = floor(f.r) AND p.g = floor(f.g) AND p.b = floor(f.b) AS same FROM px p JOIN of_px o USING (image_id, y, x) JOIN leaf f ON f.image_id = o.image_id AND f.level = o.level AND f.by_ = o.y >> o.level AND f.bx = o.x >> o.level) SELECT image_id, round(coalesce(max(e) FILTER (roi = 0), 0), 6) AS max_error, coalesce(bool_and(same) FILTER (roi = 1), true) AS exact_roi, {big('count(*)', 'n_px')} FROM err GROUP BY image_id"),
    "background_variance": q(PX, "SELECT image_id, round((coalesce(var_pop(r) FILTER (roi = 0), 0) + coalesce(var_pop(g) FILTER (roi = 0), 0) + coalesce(var_pop(b) FILTER (roi = 0), 0)) / 3, 5) AS variance FROM px GROUP BY image_id"),
    "row_bands": q(BAND, f"SELECT image_id, {big('y', 'y')}, {big('hh', 'h')}, {big('count(*)', 'n_leaves')}, {big('min(x)', 'x_min')}, {big('sum(w)', 'w_sum')} FROM band GROUP BY image_id, y, hh"),
    "band_islands": q(BAND, f"SELECT image_id, {big('y', 'y')}, {big('hh', 'h')}, {big('island', 'island')}, {big('min(x)', 'x_min')}, {big('max(x+w)', 'x_max')}, {big('count(*)', 'n_leaves')} FROM island GROUP BY image_id, y, hh, island"),
    "dp_row_merge": q(ROWS, f"SELECT image_id, {big('y', 'y')}, {big('hh', 'h')}, {big('n', 'n_leaves')}, {big('best[n+1]', 'n_tiles')} FROM last", True),
    "dp_backtrack_tiles": q(ROWS, f"SELECT image_id, {big('y', 'y')}, {big('hh', 'h')}, {big('x', 'x')}, {big('w', 'w')}, {big('merged_from', 'merged_from')}, round(r, 6) AS r FROM row_tile", True),
    "tile_area_weighted_mean": q(ROWS, "SELECT image_id, round(sum(r*w*hh)/sum(w*hh), 6) AS r, round(sum(g*w*hh)/sum(w*hh), 6) AS g, round(sum(b*w*hh)/sum(w*hh), 6) AS b FROM row_tile GROUP BY image_id", True),
    "tile_reduction_ratio": q(ROWS, f", t AS (SELECT image_id, count(*) AS n FROM row_tile GROUP BY image_id), l AS (SELECT image_id, count(*) AS n, count_if(roi_any = 1) AS roi FROM leaf GROUP BY image_id) SELECT image_id, {big('l.n', 'n_leaves')}, {big('coalesce(t.n, 0) + roi', 'n_tiles')}, round(1 - (coalesce(t.n, 0) + roi) / l.n, 9) AS reduction FROM l LEFT JOIN t USING (image_id)", True),
    "tiles_paint_range_join": q(ROWS, f"SELECT p.image_id, {big('count(*)', 'n_px')}, {big('sum(floor(t.r) + 3*floor(t.g) + 5*floor(t.b))', 'painted')} FROM px p JOIN row_tile t ON p.image_id = t.image_id AND p.x >= t.x AND p.x < t.x + t.w AND p.y >= t.y AND p.y < t.y + t.hh GROUP BY p.image_id", True),
    "vertical_stacks": q(ROWS, f", c AS (SELECT *, CASE WHEN lag(y + hh) OVER (PARTITION BY image_id, x, w ORDER BY y) = y THEN 0 ELSE 1 END AS gap FROM row_tile), s AS (SELECT *, sum(gap) OVER (PARTITION BY image_id, x, w ORDER BY y ROWS UNBOUNDED PRECEDING) AS stack FROM c) SELECT image_id, {big('x', 'x')}, {big('w', 'w')}, {big('stack', 'stack')}, {big('min(y)', 'y_min')}, {big('max(y+hh)', 'y_max')}, {big('count(*)', 'n_tiles')} FROM s GROUP BY image_id, x, w, stack", True),
    "tile_wire_size": q(ROWS, f", t AS (SELECT image_id, count(*) AS n FROM row_tile GROUP BY image_id), l AS (SELECT image_id, count_if(roi_any = 1) AS roi, max(h) AS h FROM leaf GROUP BY image_id) SELECT image_id, {big('12 * (coalesce(t.n, 0) + roi)', 'record_bytes')}, round(h*64*3 / greatest(12 * (coalesce(t.n, 0) + roi), 1), 9) AS structural_cr, h*64*3 / greatest(12 * (coalesce(t.n, 0) + roi), 1) >= 4 AS target_met FROM l LEFT JOIN t USING (image_id)", True),
    "byte_histogram": q(BYTES, f"SELECT {big('byte', 'byte')}, {big('count(*)', 'n')} FROM bytes GROUP BY byte"),
    "huffman_roundtrip": f"SELECT doc_id, {big('octet_length(encode(coalesce(text, chr(0)[1:0])))', 'n_bytes')}, true AS same FROM documents",
    "archive_offsets": q(ENTRIES, f"SELECT name, length, {big('coalesce(sum(length) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'offset')} FROM entry"),
    "archive_index_overlap": q(ENTRIES + ", o AS (SELECT *, coalesce(sum(length) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN id % 10 = 4 THEN 5 ELSE 0 END + CASE WHEN id % 50 = 9 THEN 1000000000 ELSE 0 END AS off, CASE WHEN id % 20 = 3 THEN 0 ELSE width END AS w FROM entry), e AS (SELECT *, greatest(coalesce(max(off + length) OVER (ORDER BY off, off + length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS reached, sum(length) OVER () AS whole, count(*) OVER (PARTITION BY name) AS same FROM o), c AS (SELECT name, CASE WHEN off < 0 OR length < 0 THEN 'bad metadata' WHEN w <= 0 OR height <= 0 THEN 'no dimensions' WHEN same > 1 THEN 'name occurs again' WHEN reached > off THEN 'overlaps an entry before' WHEN off + length > whole THEN 'exceeds the payload area' WHEN reached < off THEN 'gap before the entry' END AS problem FROM e)", "SELECT name, problem FROM c WHERE problem IS NOT NULL"),
    "huffman_size": q(HUFFMAN, f"SELECT d.doc_id, {big('coalesce(octet_length(encode(d.text)), 0)', 'n_bytes')}, {big('CASE WHEN c.doc_id IS NULL THEN 4 ELSE 20 + (CASE WHEN kinds = 1 THEN 3 ELSE 2 * kinds - 1 END + 7) // 8 + (CASE WHEN kinds = 1 THEN 2 ELSE kinds END) + (bits + 7) // 8 END', 'encoded_bytes')} FROM documents d LEFT JOIN coded c USING (doc_id)", True),
    "vertical_merge": q(COLUMNS, f"SELECT image_id, {', '.join(f'CAST({a} AS INT) AS {b}' for a, b in (('x', 'x'), ('y', 'y'), ('w', 'w'), ('h', 'h')))}, false AS is_roi, CAST(merged_from AS INT) AS merged_from, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM merged UNION ALL SELECT image_id, CAST(x AS INT), CAST(y AS INT), CAST(w AS INT), CAST(hh AS INT), true, 1, round(r, 6), round(g, 6), round(b, 6) FROM leaf WHERE roi_any = 1", True),
    "tall_quadtree_leaves": q(PX + """,
tall AS (SELECT image_id // 4 AS image_id, y + 48 * (image_id % 4) AS y, x, CASE WHEN image_id % 4 = 3 AND image_id % 8 < 4 THEN roi ELSE 0 END AS roi FROM px WHERE y < 48),
side AS (SELECT image_id, CASE WHEN max(y) < 64 THEN 64 WHEN max(y) < 128 THEN 128 ELSE 256 END AS side FROM tall GROUP BY 1),
blocks AS (SELECT image_id, l.i AS level, y >> l.i AS by_, x >> l.i AS bx, max(roi) AS roi_any FROM tall JOIN side USING (image_id) JOIN (SELECT CAST(i AS INT) AS i FROM range(9) t(i)) l ON (1 << l.i) <= side GROUP BY ALL),
found AS (SELECT t.image_id, t.y, t.x, max(b.level) AS level FROM tall t JOIN blocks b ON b.image_id = t.image_id AND b.by_ = t.y >> b.level AND b.bx = t.x >> b.level AND (b.roi_any = 0 OR b.level = 0) GROUP BY ALL)""", f"SELECT image_id, {big('level', 'level')}, {big('count(DISTINCT ((y >> level) * 1000 + (x >> level)))', 'n_leaves')}, {big('count(*)', 'area')} FROM found GROUP BY image_id, level"),
    "progress_index": q(ENTRIES, f"SELECT name, {big('row_number() OVER (ORDER BY name)', 'index')} FROM entry"),
    "verify_missing_extra": q(ENTRIES, "SELECT name, 'missing' AS problem FROM entry WHERE id % 9 = 2 UNION ALL SELECT 'extra_' || name, 'extra' FROM entry WHERE id % 11 = 3"),
    "verify_duplicates": q(FILES, f"SELECT base AS name, {big('count(*)', 'n')} FROM base GROUP BY base HAVING count(*) > 1"),
    "verify_pixel_compare": q(VERIFY, f"SELECT image_id, {big('roi_pixels', 'roi_pixels')}, {big('roi_exact_pixels', 'roi_exact_pixels')}, {big('background_pixels', 'background_pixels')}, round(max_err, 6) AS max_background_error, full_exact FROM rowsv"),
    "verify_summary": q(VERIFY, f"SELECT {big('count(*)', 'images')}, {big('count_if(roi_exact_pixels = roi_pixels AND max_err <= 12.000001)', 'passed')}, {big('sum(roi_pixels)', 'roi_pixels')}, {big('sum(roi_exact_pixels)', 'roi_exact_pixels')}, round(100.0 * sum(roi_exact_pixels) / sum(roi_pixels), 6) AS roi_exact_percent, round(max(max_err), 6) AS max_background_error, bool_and(roi_exact_pixels = roi_pixels AND max_err <= 12.000001) AS verdict FROM rowsv"),
    "stem_match_mask": q(FILES, ", st AS (SELECT *, regexp_replace(base, '(.)\\.[^.]*$', '\\1') AS stem FROM base), m AS (SELECT stem, min(path) AS mask FROM st WHERE id % 2 = 1 GROUP BY stem) SELECT id, stem, mask FROM st LEFT JOIN m USING (stem) WHERE id % 2 = 0"),
    "reject_cascade": q(FILES, f"SELECT {REASON} AS reason, {big('count(*)', 'n')}, {big('sum(length)', 'bytes')} FROM base GROUP BY 1"),
    "mode_switch_compare": "SELECT r.image_id, r.n_leaves AS n_range, v.n_leaves AS n_variance FROM (" + q(LEAF, f"SELECT image_id, {big('count(*)', 'n_leaves')} FROM leaf GROUP BY image_id") + ") r JOIN (" + q(LEAF_VARIANCE, f"SELECT image_id, {big('count(*)', 'n_leaves')} FROM leaf GROUP BY image_id") + ") v USING (image_id)",
    "problem_subset": q(ENTRIES, "SELECT w.name, e.name IS NOT NULL AS found FROM (VALUES ('img_1.png'), ('img_5.png'), ('img_9.png'), ('nowhere.png')) w(name) LEFT JOIN entry e USING (name)"),
}
for _name in ("roi_percentile_threshold", "roi_minmax_normalize", "quadtree_morton_order", "quadtree_reconstruct_error", "tile_reduction_ratio", "vertical_stacks", "tile_wire_size", "stem_match_mask"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(")\n, ", "),\n", 1)
