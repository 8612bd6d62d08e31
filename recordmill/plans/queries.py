"""The registered queries of the recording operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions import labels
from recordmill.operators import density, features, intervals, neighbours, profile, ranks, sampling, scalp, signals
from recordmill.plans import roles as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def bounded_annotations(spark, d) -> DataFrame:
    return profile.of_cohort(r.annotations(spark, d), profile.cohort(r.patients(spark, d)))


COHORT = f"select * from {r.ANNOTATIONS} where patient_id in (select patient_num_id from {r.PATIENTS} where split_final is distinct from -1)"
UNION = f"""select file_path, label, sum(s) as seconds from (select file_path, label, isl, max(stop_time)-min(start_time) s from
 (select *, sum(case when reached is null or start_time > reached then 1 else 0 end) over (partition by file_path, label order by start_time, stop_time rows unbounded preceding) isl from
 (select *, max(stop_time) over (partition by file_path, label order by start_time, stop_time rows between unbounded preceding and 1 preceding) reached from ({COHORT}))) group by all) group by all"""
AUDIT = f"select label, sum(seconds) as seconds, 100*sum(seconds)/sum(sum(seconds)) over () prop_pct from ({UNION}) group by label"
EVENTS = f"(select distinct file_path, label, start_time, stop_time from ({COHORT}))"
NATURAL = f"(select label, s as seconds, 100*s/sum(s) over () prop_pct from (select case label when 'click' then 'focal' when 'view' then 'focal' when 'error' then 'generalized' else label end as label, sum(stop_time-start_time) s from {EVENTS} group by 1))"
WINDOWED = f"(select label, n windows, cast(n*4.096 as double) as seconds, 100.0*n/sum(n) over () prop_pct from (select case macro_class when 'a' then 'focal' else macro_class end as label, count(*) n from {r.WINDOWS} group by 1))"
WINDOW_MAP = {"a": "focal"}


@register("annotation_audit", f"select label, round(seconds,3) as seconds, round(prop_pct,4) prop_pct from ({AUDIT})")
def _(spark, d):
    return rounded(rounded(intervals.annotation_audit(bounded_annotations(spark, d)), 3, "seconds"), 4, "prop_pct")


@register("interval_union", f"select file_path, label, round(seconds,3) as seconds from ({UNION})")
def _(spark, d):
    rows = bounded_annotations(spark, d).withColumn("label", labels.normalise_label(F.col("label")))
    return rounded(intervals.interval_union_duration(rows, ["file_path", "label"]), 3, "seconds")


@register("top_labels", f"select label, round(seconds,3) as seconds, round(prop_pct,4) prop_pct from ({AUDIT}) order by seconds desc, label limit 3")
def _(spark, d):
    return rounded(rounded(intervals.top_labels(intervals.annotation_audit(bounded_annotations(spark, d)), 3), 3, "seconds"), 4, "prop_pct")


@register(
    "event_stats",
    f"select label, count(*) n_events, round(quantile_cont(d,0.5),3) median_s, round(avg(d),3) mean_s, round(min(d),3) min_s, round(max(d),3) max_s, round(sum(d),2) total_s from (select label, stop_time-start_time d from {EVENTS} where label<>'signup') group by 1",
)
def _(spark, d):
    return rounded(rounded(intervals.event_duration_stats(bounded_annotations(spark, d), "signup"), 3, "median_s", "mean_s", "min_s", "max_s"), 2, "total_s")


@register("natural_distribution", f"select label, round(seconds,2) as seconds, round(prop_pct,4) prop_pct from {NATURAL}")
def _(spark, d):
    return rounded(rounded(intervals.natural_distribution(bounded_annotations(spark, d), mapping=r.MAPPING), 2, "seconds"), 4, "prop_pct")


@register("windowed_distribution", f"select label, windows, round(seconds,2) as seconds, round(prop_pct,4) prop_pct from {WINDOWED}")
def _(spark, d):
    return rounded(rounded(intervals.windowed_distribution(r.windows(spark, d), mapping=WINDOW_MAP), 2, "seconds"), 4, "prop_pct")


@register(
    "compare_distributions",
    f"""select source, label, round(seconds,2) as seconds, round(prop_pct,4) prop_pct, round(seconds/3600,4) as hours, round(max(prop_pct) over () * 1.18,4) pct_limit, round(max(seconds/3600) over () * 1.18,3) hours_limit,
 case label when 'focal' then 'Focal events' else upper(left(label,1))||lower(substr(label,2)) end display from (select 'natural' source, label, seconds, prop_pct from {NATURAL} union all select 'windowed', label, seconds, prop_pct from {WINDOWED})""",
)
def _(spark, d):
    n, w = intervals.natural_distribution(bounded_annotations(spark, d), mapping=r.MAPPING), intervals.windowed_distribution(r.windows(spark, d), mapping=WINDOW_MAP)
    out = intervals.compare_distributions(n, w, {"focal": "Focal events"})
    return rounded(rounded(rounded(out, 2, "seconds"), 4, "prop_pct", "hours", "pct_limit"), 3, "hours_limit")


@register(
    "distribution_difference",
    f"select coalesce(a.label,b.label) as label, round(coalesce(a.prop_pct,0),4) natural_pct, round(coalesce(b.prop_pct,0),4) windowed_pct, round(coalesce(b.prop_pct,0)-coalesce(a.prop_pct,0),4) difference from {NATURAL} a full join {WINDOWED} b on a.label=b.label",
)
def _(spark, d):
    n, w = intervals.natural_distribution(bounded_annotations(spark, d), mapping=r.MAPPING), intervals.windowed_distribution(r.windows(spark, d), mapping=WINDOW_MAP)
    return rounded(intervals.distribution_difference(n, w), 4, "natural_pct", "windowed_pct", "difference")


@register(
    "event_onset",
    f"select file_path, round(min(start_time),6) onset_s, upper(arg_min(label, line_no) ) listed_label, upper(first(label order by start_time, line_no)) as label from ({COHORT}) where label<>'signup' group by 1",
)
def _(spark, d):
    return rounded(intervals.event_onset(bounded_annotations(spark, d), "signup"), 6, "onset_s")


@register("cohort_semi_join", f"select patient_id, count(*) n from {r.ANNOTATIONS} where patient_id in (select patient_num_id from {r.PATIENTS} where split_final=0) group by 1")
def _(spark, d):
    return profile.of_cohort(r.annotations(spark, d), profile.cohort(r.patients(spark, d), split=0)).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@register("age_profile", f"select count(*) n, round(quantile_cont(age,0.25),4) q25, round(quantile_cont(age,0.5),4) median, round(quantile_cont(age,0.75),4) q75, round(quantile_cont(age,0.75)-quantile_cont(age,0.25),4) iqr from {r.PATIENTS} where age<99")
def _(spark, d):
    return rounded(profile.median_iqr(profile.known_ages(r.patients(spark, d)), "age"), 4, "q25", "median", "q75", "iqr")


@register(
    "age_histogram",
    f"""with p as (select age from {r.PATIENTS} where age<99), e as (select min(age) a, max(age) b from p),
 c as (select least(cast(floor((age-a)/((b-a)/15)) as int)+1,15) bin, count(*) n from p, e group by 1)
 select cast(g.bin as int) bin, round(a+(g.bin-1)*(b-a)/15,4) low, round(a+g.bin*(b-a)/15,4) high, coalesce(n,0) count from (select unnest(range(1,16)) bin) g cross join e left join c using(bin)""",
)
def _(spark, d):
    return rounded(profile.histogram(profile.known_ages(r.patients(spark, d)), "age"), 4, "low", "high")


def _frequency(source: str, column: str, name: str) -> str:
    return f"select {column} {name}, count(*) count, round(100.0*count(*)/sum(count(*)) over (),4) prop_pct from {source} where {column} is not null group by 1"


@register("gender_share", _frequency(f"(select case gender when 1 then 'male' when 2 then 'female' end gender from {r.PATIENTS})", "gender", "gender"))
def _(spark, d):
    return rounded(profile.gender_share(r.patients(spark, d)), 4, "prop_pct")


@register("channel_share", f"select *, n_channels<19 below_min, n_channels=18 boundary from ({_frequency(r.SESSIONS, 'n_channels', 'n_channels')})")
def _(spark, d):
    return rounded(profile.channel_share(r.sessions(spark, d)), 4, "prop_pct")


@register("rate_share", _frequency(r.SESSIONS, "sfreq", "sfreq"))
def _(spark, d):
    return rounded(profile.frequency_share(r.sessions(spark, d), "sfreq", "sfreq"), 4, "prop_pct")


@register("montage_share", _frequency(r.SESSIONS, "config_type", "config_type"))
def _(spark, d):
    return rounded(profile.frequency_share(r.sessions(spark, d), "config_type", "config_type"), 4, "prop_pct")


@register(
    "validity",
    f"select *, case when prop_pct>0 and prop_pct<0.1 then '< 0.1%' else printf('%.1f%%', prop_pct) end as text from (select position, category, count, round(100.0*count/sum(count) over (),4) prop_pct from (select 1 position, 'valid' category, count(*) filter (n_channels>=19) count from {r.SESSIONS} union all select 2, 'excluded', count(*) filter (n_channels<19) from {r.SESSIONS}))",
)
def _(spark, d):
    return rounded(profile.validity_share(r.sessions(spark, d)), 4, "prop_pct")


@register("class_map_drop", f"select case label when 'click' then 'focal' when 'view' then 'focal' else 'generalized' end macro_class, count(*) n from {r.ANNOTATIONS} where label in ('click','view','error') group by 1")
def _(spark, d):
    return labels.map_classes(r.annotations(spark, d), r.MAPPING).groupBy("macro_class").agg(F.count(F.lit(1)).alias("n"))


@register("class_map_keep", f"select case label when 'click' then 'focal' when 'view' then 'focal' when 'error' then 'generalized' else label end macro_class, count(*) n from {r.ANNOTATIONS} group by 1")
def _(spark, d):
    code = labels.normalise_label(F.col("label"))
    return r.annotations(spark, d).groupBy(labels.map_class(code, r.MAPPING, "keep").alias("macro_class")).agg(F.count(F.lit(1)).alias("n"))


@register("display_labels", f"select label, case label when 'click' then 'A Click' else upper(left(label,1))||substr(label,2) end display, case label when 'click' then 'A Click' else upper(left(label,1))||substr(label,2) end||' ('||upper(label)||')' hover, count(*) n from {r.ANNOTATIONS} group by all")
def _(spark, d):
    c = F.lower(F.col("label"))
    names = {"click": "A Click"}
    return r.annotations(spark, d).groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumns({"display": labels.display_label(F.col("label"), names), "hover": labels.hover_label(F.col("label"), names)})


SAMPLE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


@register(
    "balanced_sample",
    f"""with w as (select *, row_number() over (partition by patient_id, macro_class order by l_orderkey, l_linenumber, l_partkey, price) rn, (select ceil(300.0/count(distinct patient_id)) from {r.WINDOWS}) q from {r.WINDOWS}),
 p as (select *, case when rn<=q then 1 else 2 end ps, case when rn<=q then rn else rn-q end turn from w where rn<=300),
 l as (select patient_id, macro_class, ps, 300-coalesce(sum(n) over (partition by macro_class order by ps, patient_id rows between unbounded preceding and 1 preceding),0) take from (select patient_id, macro_class, ps, count(*) n from p group by all))
 select p.patient_id, p.macro_class, l_orderkey, l_linenumber, l_partkey, round(price,2) price from p join l using (patient_id, macro_class, ps) where turn<=take""",
)
def _(spark, d):
    out = sampling.balanced_sample(r.windows(spark, d), 300, order=[F.col(c) for c in (*SAMPLE_ORDER, "price")], patient_order=F.col("patient_id"))
    return rounded(out.select("patient_id", "macro_class", *SAMPLE_ORDER, "price"), 2, "price")


MIXED = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709 + l_suppkey * 15485863) % 1000003"


@register("sample_n", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, price from {r.WINDOWS} order by {MIXED}, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500")
def _(spark, d):
    return sampling.sample_n(r.windows(spark, d).select(*r.ROW, "price"), 500, r.ROW, order=F.expr(MIXED))


@register("robust_scale", f"with q as (select {', '.join(f'quantile_cont({c},0.5) m_{c}, quantile_cont({c},0.75)-quantile_cont({c},0.25) s_{c}' for c in r.FEATURES)} from {r.WINDOWS}) select {', '.join(r.ROW)}, {', '.join(f'round(({c}-m_{c})/case when s_{c}=0 then 1 else s_{c} end,6) {c}' for c in r.FEATURES)} from {r.WINDOWS}, q")
def _(spark, d):
    return rounded(ranks.robust_scale(r.windows(spark, d).select(*r.ROW, *r.FEATURES), r.FEATURES), 6, *r.FEATURES)


@register("sanitise", f"select macro_class, round(sum(x),2) x, sum(case when x=0 then 1 else 0 end) zeros from (select macro_class, case when quantity=1 then 0 else price end x from {r.WINDOWS}) group by 1")
def _(spark, d):
    odd = r.windows(spark, d).select("macro_class", F.when(F.col("quantity") == 1, float("inf")).otherwise(F.col("price")).alias("x"))
    return rounded(features.sanitise_numeric(odd, "macro_class").groupBy("macro_class").agg(F.sum("x").alias("x"), F.sum((F.col("x") == 0).cast("long")).alias("zeros")), 2, "x")


LONG = "(" + " union all ".join(f"select {', '.join(r.ROW)}, macro_class, '{c}' feature, {c} v from {r.WINDOWS}" for c in r.FEATURES) + ")"
RANKED = f"(select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1)/2.0 rk, count(*) over (partition by feature, v) t from {LONG})"


@register("average_rank", f"select distinct feature, v \"value\", cast(rk as double) average_rank, t ties from {RANKED}")
def _(spark, d):
    return ranks.value_ranks(ranks.long_form(r.windows(spark, d), r.FEATURES, r.ROW), ["feature"])


def _pair_sql(source: str, name: str, fs: list[str] = r.FEATURES) -> str:
    return " union all ".join(f"select '{a}' f1, '{b}' f2, round(corr({a},{b}),5) {name} from {source}" for i, a in enumerate(fs) for b in fs[i + 1 :])


@register("pearson", _pair_sql(r.WINDOWS, "r"))
def _(spark, d):
    return rounded(ranks.pearson_matrix(r.windows(spark, d), r.FEATURES), 5, "r")


WIDE_RANKS = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0 {c}" for c in r.FEATURES) + f" from {r.WINDOWS})"


@register("spearman", _pair_sql(WIDE_RANKS, "rho"))
def _(spark, d):
    return rounded(ranks.spearman_matrix(r.windows(spark, d), r.FEATURES), 5, "rho")


@register("pearson_wide", _pair_sql(r.WIDE_WINDOWS, "r", list(r.WIDE)))
def _(spark, d):
    return rounded(ranks.pearson_matrix(r.wide_windows(spark, d), list(r.WIDE)), 5, "r")


#: Those of the derived columns without a gap, as many as a heatmap by name has.
RANKED_WIDE = list(r.WIDE)[:15]
WIDE_RANKS_15 = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0 {c}" for c in RANKED_WIDE) + f" from {r.WIDE_WINDOWS})"


@register("spearman_wide", _pair_sql(WIDE_RANKS_15, "rho", RANKED_WIDE))
def _(spark, d):
    return rounded(ranks.spearman_matrix(r.wide_windows(spark, d), RANKED_WIDE), 5, "rho")


ANOVA_WIDE = " union all ".join(
    f"select '{c}' feature, round((b/(k-1))/(w/(n-k)),4) f from (select sum(n*(m-g)*(m-g)) b, sum(ss) w, count(*) k, sum(n) n from (select macro_class, count({c}) n, avg({c}) m, var_pop({c})*count({c}) ss, any_value(g) g from (select macro_class, {c}, avg({c}) over () g from {r.WIDE_WINDOWS}) group by 1))"
    for c in r.WIDE
)


@register("anova_f_wide", ANOVA_WIDE)
def _(spark, d):
    return rounded(features.anova_f(r.wide_windows(spark, d), list(r.WIDE)), 4, "f")


ANOVA = f"""(select feature, (b/(k-1))/(w/(n-k)) f from (select feature, sum(n*(m-g)*(m-g)) b, sum(ss) w, count(*) k, sum(n) n from
 (select feature, macro_class, count(*) n, avg(v) m, var_pop(v)*count(*) ss, any_value(g) g from (select *, avg(v) over (partition by feature) g from {LONG}) group by 1,2) group by 1))"""


@register("anova_f", f"select feature, round(f,4) f from {ANOVA}")
def _(spark, d):
    return rounded(features.anova_f(r.windows(spark, d), r.FEATURES), 4, "f")


MRMR = f"""(with f as {ANOVA}, r0 as ({_pair_sql(r.WINDOWS, 'r')}), c as (select f1,f2,greatest(abs(r),0.001) r from r0 union all select f2,f1,greatest(abs(r),0.001) from r0),
 s1 as (select feature from f where f>0 order by f desc limit 1),
 s2 as (select feature from f join c on c.f1=feature where f>0 and c.f2=(select feature from s1) order by f/r desc limit 1),
 s3 as (select feature from (select feature, any_value(f) f, avg(r) r from f join c on c.f1=feature where f>0 and feature not in (select feature from s1 union all select feature from s2) and c.f2 in (select feature from s1 union all select feature from s2) group by 1) order by f/r desc limit 1)
 select 1 mrmr_rank, feature from s1 union all select 2, feature from s2 union all select 3, feature from s3)"""


@register("mrmr", f"select * from {MRMR}")
def _(spark, d):
    chosen = features.mrmr_select(r.windows(spark, d), r.FEATURES, k=3)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "mrmr_rank int, feature string")


def _psi(n: str) -> str:
    """The logarithmic derivative of the gamma function at a positive integer: sums of reciprocals, and its asymptotic series beyond 8."""
    small = " + ".join(f"case when {n} > {i} then 1.0/{i} else 0 end" for i in range(1, 8))
    y = f"(1.0/(cast({n} as double)*{n}))"
    return f"case when {n} <= 8 then {small} - {features.EULER} else ln({n}) - 0.5/{n} - {y}*(1.0/12 - {y}*(1.0/120 - {y}*(1.0/252 - {y}*(1.0/240 - {y}/132)))) end"


_STEPS = ", ".join(f"abs(v - {f}(v,{i}) over w)" for i in (1, 2, 3) for f in ("lag", "lead"))
MUTUAL = f"""(with g as (select feature, macro_class c, v x, count(*) over (partition by feature, macro_class) n_c, list_sort(list_filter([{_STEPS}], lambda y: y is not null)) gaps
  from {LONG} window w as (partition by feature, macro_class order by v)),
 b as (select feature, x, n_c, least(3, n_c-1) k, gaps[least(3, n_c-1)] rad, row_number() over () id from g where n_c > 1),
 e as (select feature, x as spot, 1 side, 1 one, null id from b union all select feature, x-rad, 2, 0, id from b union all select feature, x+rad, 0, 0, id from b),
 u as (select *, sum(one) over (partition by feature order by spot, side rows unbounded preceding) upto from e),
 m as (select id, cast(greatest(max(case when side=0 then upto end) - max(case when side=2 then upto end), 1) as bigint) m from u where id is not null group by 1),
 t as (select feature, count(*) n, avg({_psi('k')}) a, avg({_psi('n_c')}) b, avg({_psi('m')}) d from b join m using (id) group by 1)
 select feature, greatest(0, {_psi('n')} + a - b - d) mutual_info from t)"""


@register("mutual_info", f"select feature, round(mutual_info,6) mutual_info from {MUTUAL}")
def _(spark, d):
    return rounded(features.mutual_info(r.windows(spark, d), r.FEATURES, r.ROW, noise=0.0), 6, "mutual_info")


@register("mutual_info_with_noise")
def _(spark, d):
    return rounded(features.mutual_info(r.windows(spark, d), r.FEATURES, r.ROW), 6, "mutual_info")


@register(
    "rank_features",
    f"select s.mrmr_rank, s.feature, round(m.mutual_info,6) mutual_info, round(q.iqr,6) iqr from {MRMR} s join {MUTUAL} m on m.feature=s.feature join (select feature, quantile_cont(v,0.75)-quantile_cont(v,0.25) iqr from {LONG} group by 1) q on q.feature=s.feature",
)
def _(spark, d):
    rows = r.windows(spark, d).select(*r.ROW, "macro_class", *r.FEATURES)
    return rounded(features.rank_features(rows, r.ROW, top_k=3, noise=0.0), 6, "mutual_info", "iqr")


KRUSKAL = f"""(select feature, n, h, exp(-h/2) p, h*(n+1)/(n*n-1) epsilon_sq from (select feature, n, (12.0/(n*(n+1))*s-3*(n+1))/(1-tied/(n*n*n-n)) h from
 (select feature, sum(r*r/n) s, sum(n) n from (select feature, macro_class, sum(rk) r, cast(count(*) as double) n from {RANKED} group by 1,2) group by 1) join
 (select feature, sum(cast(t as double)*t*t-t) tied from (select distinct feature, v, t from {RANKED}) group by 1) using (feature)))"""


@register(
    "kruskal",
    f"""select feature, round(h,4) h, round(p,6) p, round(least(1, max(a) over (order by j rows unbounded preceding)),6) p_holm, round(epsilon_sq,8) epsilon_sq, round(median_a,4) median_a, round(median_n,4) median_n, round(median_r,4) median_r from
 (select *, (count(*) over () - row_number() over (order by p) + 1)*p a, row_number() over (order by p) j from {KRUSKAL}) join
 (select feature, quantile_cont(v,0.5) filter (macro_class='a') median_a, quantile_cont(v,0.5) filter (macro_class='n') median_n, quantile_cont(v,0.5) filter (macro_class='r') median_r from {LONG} group by 1) using (feature)""",
)
def _(spark, d):
    out = ranks.kruskal(r.windows(spark, d), r.FEATURES, classes=r.CLASSES)
    out = out.select("feature", "h", "p", "p_holm", "epsilon_sq", *[f"median_{c}" for c in r.CLASSES])
    return rounded(rounded(rounded(out, 4, "h", *[f"median_{c}" for c in r.CLASSES]), 6, "p", "p_holm"), 8, "epsilon_sq")


def _two_places(x: str) -> str:
    """A number as text with two decimals, halves rounded up, as format_string does."""
    return f"cast(cast(round(cast({x} as decimal(18,6)), 2) as decimal(18,2)) as varchar)"


def _quartiles(c: str) -> str:
    q = {p: f"quantile_cont(v,{p}) filter (macro_class='{c}')" for p in (0.25, 0.5, 0.75)}
    iqr = f"({q[0.75]} - {q[0.25]})"
    return f"round({iqr},4) iqr_{c}, {_two_places(q[0.5])} || ' (' || {_two_places(iqr)} || ')' text_{c}"


@register(
    "kruskal_effects",
    f"""select feature, cast(n as double) n, 3 k, case when epsilon_sq<0.01 then 'negligible' when epsilon_sq<0.08 then 'small' when epsilon_sq<0.26 then 'medium' else 'large' end magnitude,
 {_two_places('h')} || case when p_holm<0.001 then '***' when p_holm<0.01 then '**' when p_holm<0.05 then '*' else '' end h_text, {", ".join(f"iqr_{c}, text_{c}" for c in r.CLASSES)} from
 (select *, least(1, max(a) over (order by j rows unbounded preceding)) p_holm from (select *, (count(*) over () - row_number() over (order by p) + 1)*p a, row_number() over (order by p) j from {KRUSKAL})) join (select feature, {', '.join(map(_quartiles, r.CLASSES))} from {LONG} group by 1) using (feature)""",
)
def _(spark, d):
    out = ranks.kruskal(r.windows(spark, d), r.FEATURES, classes=r.CLASSES)
    told = [x for c in r.CLASSES for x in (f"iqr_{c}", f"text_{c}")]
    return rounded(out.select("feature", "n", F.col("k").cast("int").alias("k"), "magnitude", "h_text", *told), 4, *[f"iqr_{c}" for c in r.CLASSES])


PAIRWISE = """select feature, '{a}' class1, '{b}' class2, cast(n1 as double) n1, cast(n2 as double) n2, round(u,1) u, round((u-n1*n2/2)/sqrt(n1*n2*(n1+n2+1)/12),6) z, round(abs((u-n1*n2/2)/sqrt(n1*n2*(n1+n2+1)/12))/sqrt(n1+n2),6) r from
 (select feature, cast(count(*) filter (macro_class='{a}') as double) n1, cast(count(*) filter (macro_class='{b}') as double) n2, sum(rk) filter (macro_class='{a}') - count(*) filter (macro_class='{a}') * (count(*) filter (macro_class='{a}')+1)/2.0 u from
 (select feature, macro_class, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v)-1)/2.0 rk from {long} where macro_class in ('{a}','{b}')) group by 1)"""
MW_PAIRS = (("a", "n"), ("a", "r"), ("n", "r"))


@register("mann_whitney", " union all ".join(PAIRWISE.format(a=a, b=b, long=LONG) for a, b in MW_PAIRS))
def _(spark, d):
    out = ranks.mann_whitney(r.windows(spark, d), r.FEATURES, pairs=MW_PAIRS)
    return rounded(rounded(out.select("feature", "class1", "class2", "n1", "n2", "u", "z", "r"), 1, "u"), 6, "z", "r")


@register("mann_whitney_tests")
def _(spark, d):
    return rounded(ranks.mann_whitney(r.windows(spark, d), r.FEATURES, pairs=MW_PAIRS).select("feature", "class1", "class2", "p", "p_holm"), 6, "p", "p_holm")


def _bins(c: str) -> str:
    return f"""(select low, case when span=0 then 1 else span/bins end width, bins from (select low, span, greatest(1, cast(ceil(span/w) as int)) bins from (select min({c}) low, max({c})-min({c}) span,
 least(2*(quantile_cont({c},0.75)-quantile_cont({c},0.25))/pow(count(*),1/3.0), (max({c})-min({c}))/(log2(count(*))+1)) w from {r.WINDOWS})))"""


@register(
    "class_histogram",
    f"""with f as {_bins('price')}, c as (select macro_class, least(cast(floor((price-low)/width) as int)+1, bins) bin, count(*) n from {r.WINDOWS}, f group by 1,2), t as (select macro_class, sum(n) total from c group by 1)
 select t.macro_class as class, cast(b.bin as int) bin, round(low+(b.bin-1)*width,3) low, round(low+b.bin*width,3) high, round(coalesce(n,0)/total,6) proportion from t, f, (select unnest(range(1, bins+1)) bin from f) b left join c on c.macro_class=t.macro_class and c.bin=b.bin""",
)
def _(spark, d):
    return rounded(rounded(density.class_histogram(r.windows(spark, d), "price"), 3, "low", "high"), 6, "proportion")


@register(
    "kde",
    f"""with e as (select min(quantity) a, max(quantity) b from {r.WINDOWS}), p as (select macro_class c, cast(count(*) as double) n, stddev_samp(quantity)*pow(count(*),-0.2) h from {r.WINDOWS} group by 1),
 v as (select macro_class c, quantity q, count(*) m from {r.WINDOWS} group by 1,2), g as (select i, a+(b-a)*i/199 x from e, (select unnest(range(0,200)) i))
 select v.c as class, cast(i as int) i, round(any_value(x),5) x, round(sum(m*exp(-0.5*pow((x-q)/h,2)))/(any_value(n)*any_value(h)*2.5066282746310002)*any_value(width),8) density from v join p using (c), g, {_bins('quantity')} group by 1,2""",
)
def _(spark, d):
    return rounded(rounded(density.kde_grid(r.windows(spark, d), "quantity", cells=0), 5, "x"), 8, "density")


@register(
    "kde_price",
    f"""with e as (select min(price) a, max(price) b from {r.WINDOWS}), p as (select macro_class c, cast(count(*) as double) n, stddev_samp(price)*pow(count(*),-0.2) h from {r.WINDOWS} group by 1),
 v as (select macro_class c, price q, count(*) m from {r.WINDOWS} group by 1,2), g as (select i, a+(b-a)*i/199 x from e, (select unnest(range(0,200)) i))
 select v.c as class, cast(i as int) i, round(any_value(x),3) x, round(sum(m*exp(-0.5*pow((x-q)/h,2)))/(any_value(n)*any_value(h)*2.5066282746310002)*any_value(width),6) density from v join p using (c), g, {_bins('price')} group by 1,2""",
)
def _(spark, d):
    return rounded(rounded(density.kde_grid(r.windows(spark, d), "price"), 3, "x"), 6, "density")


MONTAGE = f"(select macro_class, quantity a, price/1000 b, quantity*discount c, price*tax/1000 d from {r.WINDOWS})"
POINTS = f"""(select feature, macro_class, quantile_cont(v,0.5) median, any_value(x) x, any_value(y) y from (
 select 'Fp1-F7_entropy' feature, macro_class, a v, -0.55 x, 0.65 y from {MONTAGE} union all select 'F7-T3_entropy', macro_class, b, -0.9, 0.2 from {MONTAGE} union all
 select 'C3-Cz_entropy', macro_class, c, -0.25, 0.0 from {MONTAGE} union all select 'Pz-O2_entropy', macro_class, d, 0.15, -0.7 from {MONTAGE}) group by 1,2)"""


@register("class_medians", f"select feature, macro_class as class, round(median,4) median from {POINTS}")
def _(spark, d):
    return rounded(scalp.class_medians(r.montage_windows(spark, d), r.PAIRS, classes=r.CLASSES), 4, "median")


@register("montage_points", f"select feature, macro_class as class, round(median,4) median, round(cast(x as double),4) x, round(cast(y as double),4) y, round(min(median) over (),4) low, round(max(median) over (),4) high from {POINTS}")
def _(spark, d):
    return rounded(scalp.montage_points(r.montage_windows(spark, d), "_entropy", classes=r.CLASSES), 4, "median", "x", "y", "low", "high")


@register("scalp_grid")
def _(spark, d):
    return rounded(scalp.scalp_grid(scalp.montage_points(r.montage_windows(spark, d), "_entropy", classes=r.CLASSES)), 4, "x", "y", "z")


@register("rank_pca_variance")
def _(spark, d):
    return rounded(ranks.rank_pca(r.windows(spark, d), r.FEATURES, r.ROW)[0], 5, "eigenvalue", "explained", "cumulative")


@register("rank_pca_scores")
def _(spark, d):
    pcs = [f"pc{i + 1}" for i in range(4)]
    return rounded(ranks.rank_pca(r.windows(spark, d), r.FEATURES, r.ROW)[1].select(*r.ROW, *pcs), 5, *pcs)


def _knn_sql(distance: str, k: int) -> str:
    return f"""with v as (select vec_id, cast(embedding as double[]) e from embeddings)
 select id, neighbour, round(dist,6) distance, cast(rank as int) rank from (select *, row_number() over (partition by id order by dist, neighbour) rank from (select a.vec_id id, b.vec_id neighbour, {distance} dist from v a join v b on a.vec_id<>b.vec_id)) where rank<={k}"""


@register("knn_euclidean", _knn_sql("list_distance(a.e, b.e)", 80))
def _(spark, d):
    return rounded(neighbours.knn_graph(r.table(spark, d, "embeddings"), "vec_id", "embedding", 80), 6, "distance")


@register("knn_cosine", _knn_sql("1-list_cosine_similarity(a.e, b.e)", 50))
def _(spark, d):
    return rounded(neighbours.knn_graph(r.table(spark, d, "embeddings"), "vec_id", "embedding", 50, "cosine"), 6, "distance")


@register("knn_approximate")
def _(spark, d):
    return rounded(neighbours.neighbour_descent(r.table(spark, d, "embeddings"), "vec_id", "embedding", 80)[0], 6, "distance")


@register("class_values", f"select distinct macro_class as value from {r.WINDOWS}")
def _(spark, d):
    return profile.distinct_sorted(r.windows(spark, d), "macro_class")


@register("cohort_windows", f"select patient_id, count(*) n, round(sum(price),2) price from {r.WINDOWS} where patient_id in (select patient_num_id from {r.PATIENTS} where split_final=0) group by 1")
def _(spark, d):
    rows = profile.of_cohort(r.windows(spark, d), profile.cohort(r.patients(spark, d), split=0))
    return rounded(rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price")), 2, "price")


GAPPED = "(select case when l_linenumber % 5 = 0 then null else l_quantity end quantity, l_extendedprice price, case when l_orderkey % 7 = 0 then null else l_discount end discount from lineitem)"


def _spearman_pairs(names: list[str]) -> str:
    one = """select '{a}' f1, '{b}' f2, round(corr(ra, rb),5) rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1)/2.0 ra, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1)/2.0 rb
 from {t} where {a} is not null and {b} is not null)"""
    return " union all ".join(one.format(a=a, b=b, t=GAPPED) for i, a in enumerate(names) for b in names[i + 1 :])


@register("spearman_pairwise", _spearman_pairs(["quantity", "price", "discount"]))
def _(spark, d):
    w = r.windows(spark, d)
    rows = w.select(F.when(F.col("l_linenumber") % 5 != 0, F.col("quantity")).alias("quantity"), "price", F.when(F.col("l_orderkey") % 7 != 0, F.col("discount")).alias("discount"))
    return rounded(ranks.spearman_matrix(rows, ["quantity", "price", "discount"]), 5, "rho")


@register(
    "signal_excerpt",
    f"""with k as (select file_path, name, channel_no, row_number() over (partition by file_path order by w)-1 trace from (select distinct file_path, name, channel_no, case name when 'CZ' then 0 when 'O1' then 1 when 'FP1' then 2 end w from {r.SIGNALS} where name in ('CZ','O1','FP1')))
 select s.file_path, 'EEG '||s.name||'-REF' channel, s.name as label, cast(trace as int) trace, sample_index, t, round(value*1e6,3) uv, round(value*1e6+trace*800,3) stacked from {r.SIGNALS} s join k on k.file_path=s.file_path and k.name=s.name where t between 0 and 2""",
)
def _(spark, d):
    return rounded(signals.signal_excerpt(r.signals(spark, d), ["CZ", "XX", "O1", "FP1"], 0, 2), 3, "uv", "stacked")


@register(
    "onset_excerpt",
    f"""with o as (select file_path, cast(cast(file_path as int) % 7 as double) onset from {r.SIGNALS} group by 1), c as (select s.* from {r.SIGNALS} s join o using (file_path) where channel_no<3 and sample_index>=floor(greatest(0,onset-1)*8) and sample_index<floor((greatest(0,onset-1)+3)*8))
 select c.file_path, 'EEG '||name||'-REF' channel, channel_no trace, sample_index, sample_index/8.0 t, round((value-m)/s,5) scaled, round((value-m)/s-channel_no,5) stacked from c join (select file_path, channel_no, avg(value) m, max(value)-min(value) s from c group by 1,2) using (file_path, channel_no)""",
)
def _(spark, d):
    x = r.signals(spark, d)
    onsets = x.select("file_path").distinct().withColumn("onset_s", (F.col("file_path").cast("int") % 7).cast("double"))
    return rounded(signals.onset_excerpt(x, onsets, 1, 3, 8), 5, "scaled", "stacked")
