"""Queries on the signature database, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.operators import blocks as blk
from pixsieve.operators import signatures as sg
from pixsieve.plans import inputs as inp
from pixsieve.plans import packed
from pixsieve.sources import files, sigdb
from pixsieve.sources.dims import local_rows

MARKERS = ("blue widget", "red bolt")


def _exc(spark: SparkSession, rows) -> DataFrame:
    return local_rows(spark, rows, "make STRING, model STRING")


def _sigs(spark, d):
    return inp.signatures(spark, d)


def sig_exact(spark, d):
    return sg.exact_hits(inp.images(spark, d), _sigs(spark, d).where("NOT is_user"))


def sigdb_trim(spark, d):
    s = _sigs(spark, d)
    return sg.trim_known(s.where("is_user"), s.where("NOT is_user")).select("sig_id", "make", "model", "csig")


def exc_prefix(spark, d):
    return sg.no_makernote_expected(inp.images(spark, d), _exc(spark, inp.EXC_NO_MAKERNOTE)).select("image_id", "make", "model")


def exc_exact(spark, d):
    return sg.always_edited(inp.images(spark, d), _exc(spark, inp.EXC_IS_EDIT)).select("image_id", "make", "model")


def sigdb_counts(spark, d):
    return sg.count_signatures(_sigs(spark, d))


def sigdb_union(spark, d):
    s = _sigs(spark, d)
    return sg.union_tables(s.where("NOT is_user").drop("is_user"), s.where("is_user").drop("is_user"))


def sigdb_delete(spark, d):
    s = _sigs(spark, d)
    return sg.keep_listed(s, s.where("quality <> '7'").select("sig_id")).select("sig_id", "is_user", "valid")


def sigdb_append(spark, d):
    new = inp.table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("sig_id"),
        F.concat(F.lit("Make#"), F.col("s_nationkey").cast("string")).alias("make"),
        F.col("s_name").alias("model"),
        F.lit("fine").alias("quality"),
        F.upper(F.md5("s_name")).alias("csig"),
        F.upper(F.md5(F.reverse("s_name"))).alias("csig_rot"),
        sg.source_of_choice(F.col("s_suppkey") % 3).alias("source"),
        F.concat(F.lit("tool "), F.col("s_name")).alias("user_software"),
    )
    base = _sigs(spark, d).where("is_user").withColumns({"sw_trim": F.lit(""), "sw_disp": F.lit("")})
    return sg.append_user(base, new)


def sigdb_load(spark, d):
    s = _sigs(spark, d).drop("is_user", "valid")
    kind = F.col("sig_id") % 4
    parts = {f"0{v}": s.where(kind == v) for v in range(4)}
    parts["01"] = parts["01"].drop("csig_rot")
    return sigdb.load_versions(parts).select("sig_id", "version", "valid", "make", "model", "csig", "csig_rot", "sw_disp")


def sigdb_store(spark, d):
    return sigdb.storable(_sigs(spark, d))


def sigdb_update(spark, d):
    """A stored table loaded, edited and stored to the same place, then read again."""
    target = files.shared_folder(spark)
    sigdb.store(_sigs(spark, d), target)
    loaded = sigdb.load(spark, target)
    edited = loaded.withColumns({"quality": F.concat("quality", F.lit("!")), "valid": F.col("sig_id") % 3 > 0})
    sigdb.store(edited, target)
    return sigdb.load(spark, target).select("sig_id", "make", "model", "quality", "csig")


HEADER = "signature table"


def binary_tables(spark, d):
    """Suppliers as binary tables, one file per nation: versions 00 to 04 by nation, 03 in UTF-16, one record cut off in every seventh."""
    s = inp.table(spark, d, "supplier").withColumns({"n": F.col("s_nationkey"), "k": F.col("s_suppkey")})
    version = F.format_string("%02d", F.col("n") % 5)
    coding = lambda c: F.when(F.col("n") % 5 == 3, F.encode(c, "UTF-16LE")).otherwise(F.encode(c, "ISO-8859-1"))
    old = F.col("n") % 5 == 1
    sig = F.upper(F.md5("s_name"))
    texts = F.concat_ws("\0", F.concat(F.lit("Make#"), "n"), "s_name", (F.col("k") % 6).cast("string"), F.lit("fine"), sig,
                        F.when(~old, F.reverse(sig)), F.lit("2x1"), F.lit(""), F.concat(F.lit("tool "), "k"))
    per = s.groupBy("n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat(texts, F.lit("\0")).alias("t")))), lambda r: r["t"]), "").alias("body"), F.count("*").alias("held"))
    head = F.concat(F.lit(f"{HEADER}\0"), version, F.lit("\0*DB*\0"))
    body = F.when(F.col("n") % 7 == 0, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.concat("body", F.lit("*Z*\0")))
    content = F.concat(coding(head), packed.ordered(F.col("held"), 4, F.lit(True)), coding(body))
    return per.select(F.col("n").alias("path"), packed.sealed(content, "content"))


def sigdb_binary(spark, d):
    return sigdb.read_binary(binary_tables(spark, d), HEADER)


def sig_verdict(spark, d):
    k = F.col("p_partkey")
    # software rows hash the type (and also the name of blue parts), camera rows the name: every branch occurs
    extra = inp.table(spark, d, "part").select(
        k.alias("image_id"),
        F.when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("make"),
        F.col("p_type").alias("model"),
        F.upper(F.md5(F.when(k % 5 == 0, F.col("p_brand")).when(k % 5 == 1, F.col("p_type")).otherwise(F.col("p_name")))).alias("sig"),
        F.col("p_name").alias("software"),
        (k % 4 != 0).alias("has_makernote"),
    )
    hashed = F.when((k % 3 == 1) & ~F.startswith(F.col("p_name"), F.lit("blue")), F.col("p_type")).otherwise(F.col("p_name"))
    sigs = inp.signatures(spark, d, hashed)
    return sg.verdicts(extra, sigs, _exc(spark, inp.EXC_IS_EDIT), _exc(spark, inp.EXC_NO_MAKERNOTE), MARKERS)


def label_verdicts(spark, d):
    """Blocks to tables, tables to signatures, signatures against a built-in plus user union, counts per label.

    The built-in rows are the first table of each label, the user rows the last one, stored rotated.
    """
    tables = inp.block_arrays(spark, d).select(
        "block_id", "image_id", F.transform("q", lambda v: (F.lit(1) + F.abs(v) % 255).cast("int")).alias("table_zz")
    )
    plain, turned = blk.table_signature(F.col("table_zz")), blk.table_signature(blk.rotate_table(F.col("table_zz")))
    images = tables.select("image_id", plain.alias("sig"))
    builtin = tables.groupBy("image_id").agg(F.min_by("table_zz", "block_id").alias("table_zz"))
    user = tables.groupBy("image_id").agg(F.max_by("table_zz", "block_id").alias("table_zz"))
    known = sg.union_tables(
        builtin.select(plain.alias("csig"), turned.alias("csig_rot")),
        user.select(turned.alias("csig"), plain.alias("csig_rot")),
    )
    known = sg.hash_keys(known, "is_user").groupBy("sig").agg(F.max("is_user").alias("is_user"))
    return images.join(known, "sig", "left").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("is_user").isNotNull()).alias("n_known"),
        F.count_if(F.col("is_user")).alias("n_user"),
    )


QUERIES = {
    "sig_exact": sig_exact,
    "sigdb_trim": sigdb_trim,
    "exc_prefix": exc_prefix,
    "exc_exact": exc_exact,
    "sigdb_counts": sigdb_counts,
    "sigdb_union": sigdb_union,
    "sigdb_delete": sigdb_delete,
    "sigdb_append": sigdb_append,
    "sigdb_load": sigdb_load,
    "sigdb_store": sigdb_store,
    "sigdb_update": sigdb_update,
    "sigdb_binary": sigdb_binary,
    "sig_verdict": sig_verdict,
    "label_verdicts": label_verdicts,
}

_NOMKR = inp.values_sql("exc", "make, model", inp.EXC_NO_MAKERNOTE)
_EDIT = inp.values_sql("exc", "make, model", inp.EXC_IS_EDIT)
_NOMKR2 = inp.values_sql("exc_mkr", "make, model", inp.EXC_NO_MAKERNOTE)

ORACLE = {
    "sig_exact": f"""WITH {inp.SIGNATURES}, {inp.IMAGES}
SELECT image_id, make, model, sig FROM images i WHERE EXISTS (SELECT 1 FROM signatures s WHERE NOT s.is_user
  AND s.make = i.make AND s.model = i.model AND (s.csig = i.sig OR s.csig_rot = i.sig))""",
    "sigdb_trim": f"""WITH {inp.SIGNATURES}
SELECT sig_id, make, model, csig FROM signatures u WHERE is_user AND NOT EXISTS (SELECT 1 FROM signatures s
  WHERE NOT s.is_user AND s.make = u.make AND s.model = u.model AND (s.csig = u.csig OR s.csig_rot = u.csig))""",
    "exc_prefix": f"""WITH {inp.IMAGES}, {_NOMKR}
SELECT image_id, make, model FROM images i WHERE EXISTS (SELECT 1 FROM exc e WHERE e.make = i.make
  AND (e.model = '' OR starts_with(i.model, split_part(e.model, '*', 1))))""",
    "exc_exact": f"""WITH {inp.IMAGES}, {_EDIT}
SELECT image_id, make, model FROM images i WHERE EXISTS (SELECT 1 FROM exc e WHERE e.make = i.make
  AND (e.model = '' OR e.model = i.model))""",
    "sigdb_counts": f"""WITH {inp.SIGNATURES}
SELECT CASE WHEN is_user THEN 'user' ELSE 'builtin' END AS kind, count(*) AS n FROM signatures GROUP BY is_user
UNION ALL SELECT 'total', count(*) FROM signatures""",
    "sigdb_union": f"""WITH {inp.SIGNATURES} SELECT * FROM signatures""",
    "sigdb_delete": f"""WITH {inp.SIGNATURES}
SELECT sig_id, is_user, CASE WHEN is_user THEN quality <> '7' ELSE valid END AS valid FROM signatures""",
    "sigdb_append": f"""WITH {inp.SIGNATURES}
SELECT *, '' AS sw_trim, '' AS sw_disp FROM signatures WHERE is_user
UNION ALL
SELECT s_suppkey + 1000000000, true, true, CASE s_suppkey % 3 WHEN 0 THEN 'camera' WHEN 1 THEN 'software' ELSE 'unsure' END,
  CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE 'Make#' || s_nationkey END, CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE s_name END,
  'fine', upper(md5(s_name)), upper(md5(reverse(s_name))), '', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'tool ' || s_name END
FROM supplier""",
    "sigdb_load": f"""WITH {inp.SIGNATURES}
SELECT sig_id, '0' || (sig_id % 4) AS version, true AS valid, make, model, csig,
  CASE WHEN sig_id % 4 = 1 THEN '' ELSE csig_rot END AS csig_rot, '' AS sw_disp FROM signatures WHERE sig_id % 4 <> 0""",
    "sigdb_store": f"""WITH {inp.SIGNATURES} SELECT * FROM signatures WHERE is_user AND valid""",
    "sigdb_update": f"""WITH {inp.SIGNATURES} SELECT sig_id, make, model, quality || '!' AS quality, csig FROM signatures WHERE is_user AND valid AND sig_id % 3 > 0""",
    "sigdb_binary": """WITH s AS (SELECT *, s_nationkey AS n, s_suppkey AS k, s_nationkey % 7 = 0 AND s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) AS cut FROM supplier)
SELECT n AS path, printf('%02d', n % 5) AS version, CAST(row_number() OVER (PARTITION BY n ORDER BY k) - 1 AS INTEGER) AS seq, NOT cut AS valid,
  ['unset', 'camera', 'software', 'unsure', 'unset', 'unset'][k % 6 + 1] AS editor_class, 'Make#' || n AS make, s_name AS model, 'fine' AS quality,
  upper(md5(s_name)) AS csig, CASE WHEN n % 5 = 1 THEN '' ELSE reverse(upper(md5(s_name))) END AS csig_rot, '2x1' AS subsampling, '' AS sw_trim,
  CASE WHEN cut THEN substr('tool ' || k, 1, length('tool ' || k) - 2) ELSE 'tool ' || k END AS sw_disp FROM s WHERE n % 5 IN (1, 2, 3)""",
    "sig_verdict": f"""WITH {inp.SIGNATURES}, {_EDIT}, {_NOMKR2},
img AS (SELECT p_partkey AS image_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS make, p_type AS model,
  upper(md5(CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END)) AS sig,
  p_name AS software, p_partkey % 4 <> 0 AS has_makernote FROM part),
hs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 AND NOT starts_with(p_name, 'blue') THEN p_type ELSE p_name END AS hashed FROM part),
live AS (SELECT sig_id, editor_class, make, model, upper(md5(hashed)) AS csig, upper(md5(reverse(hashed))) AS csig_rot
  FROM signatures JOIN hs ON sig_id = id WHERE valid),
h AS (SELECT *,
  (SELECT count(*) FROM live s WHERE editor_class = 'software' AND (s.csig = i.sig OR s.csig_rot = i.sig)) AS n_software,
  (SELECT count(*) FROM live s WHERE editor_class = 'camera' AND s.make = i.make AND s.model = i.model
     AND (s.csig = i.sig OR s.csig_rot = i.sig)) AS n_camera,
  EXISTS (SELECT 1 FROM exc e WHERE e.make = i.make AND (e.model = '' OR e.model = i.model)) AS exc_edit,
  EXISTS (SELECT 1 FROM exc_mkr e WHERE e.make = i.make AND starts_with(i.model, split_part(e.model, '*', 1))) AS mkr
  FROM img i)
SELECT image_id, n_software, n_camera,
  CASE WHEN exc_edit THEN 'YES' WHEN contains(software, 'blue widget') OR contains(software, 'red bolt') THEN 'YES'
       WHEN n_software > 0 AND n_camera = 0 THEN 'YES' WHEN n_software > 0 THEN 'UNSURE'
       WHEN n_camera > 0 AND NOT has_makernote AND NOT mkr THEN 'YESPROB' WHEN n_camera > 0 THEN 'NO'
       WHEN make = '' THEN 'YESPROB' ELSE 'UNSURE' END AS edited,
  CASE WHEN n_software + n_camera > 0 THEN 'unset'
       WHEN contains(software, 'blue widget') OR contains(software, 'red bolt') THEN 'software'
       WHEN make = '' THEN 'unset' ELSE 'camera' END AS db_action
FROM h""",
    "label_verdicts": f"""WITH {inp.BLOCKS},
t AS (SELECT block_id, image_id, pos, 1 + abs(q) % 255 AS v FROM blocks),
sigs AS (SELECT block_id, image_id, upper(md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos))) AS sig,
  upper(md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY ({inp.UNZZ_SQL})[({inp.ROT_SQL})[({inp.ZZ_SQL})[pos+1]+1]+1]))) AS rot
  FROM t GROUP BY block_id, image_id),
ends AS (SELECT min(block_id) AS lo, max(block_id) AS hi FROM sigs GROUP BY image_id),
known AS (SELECT csig, max(is_user) AS is_user FROM (
  SELECT unnest([sig, rot]) AS csig, 0 AS is_user FROM sigs WHERE block_id IN (SELECT lo FROM ends)
  UNION ALL SELECT unnest([sig, rot]), 1 FROM sigs WHERE block_id IN (SELECT hi FROM ends)) GROUP BY csig)
SELECT image_id, count(*) AS n_blocks, count(is_user) AS n_known, count(*) FILTER (is_user = 1) AS n_user
FROM sigs LEFT JOIN known ON sig = csig GROUP BY image_id""",
}
