"""Team aggregates, health, labels and warnings.

members: scored authors with team, domain, repos and label structs role, style, state; see scoring.with_labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.soft import NONE, axis_high, clamp, health_high, pick_best_label, presence

AVERAGES = (
    "production", "quality", "survival", "robust_survival", "dormant_survival", "design", "breadth", "debt_cleanup", "indispensability",
    "impact",
)
ROLES = ("Architect", "Anchor", "Cleaner", "Producer", "Specialist")
STYLES = ("Builder", "Resilient", "Rescue", "Churn", "Mass", "Emergent", "Balanced", "Spread")
STATES = ("Former", "Silent", "Fragile", "Growing", "Active")
CORE_IMPACT = 20


def team_members(scores: DataFrame, teams: DataFrame) -> DataFrame:
    """scores(domain, author, ..) ⋈ teams(team, domain, member); a null member takes in the whole domain."""
    t = teams.select("team", F.col("domain").alias("_domain"), "member")
    hit = (F.col("domain") == F.col("_domain")) & (F.col("member").isNull() | (F.col("member") == F.col("author")))
    return scores.join(F.broadcast(t), hit).drop("_domain", "member")  # teams come from a settings file


def team_tiers(members: DataFrame) -> DataFrame:
    """risk: Former, Silent or Fragile; core: otherwise active with impact 20 or more; else peripheral."""
    risk = F.col("state.name").isin("Former", "Silent", "Fragile")
    core = F.col("recently_active") & (F.col("impact") >= CORE_IMPACT)
    return members.withColumn("tier", F.when(risk, "risk").when(core, "core").otherwise("peripheral"))


def weighted_ratio(hit: Column) -> Column:
    """The members' weight max(impact / 100, 0.1) of those that hit over all."""
    w = F.greatest(F.col("impact") / 100, F.lit(0.1))
    return F.coalesce(F.sum(F.when(hit, w).otherwise(0.0)) / F.sum(w), F.lit(0.0))


def aggregate(members: DataFrame) -> DataFrame:
    """One row a team: counts, core averages, label counts and weighted label ratios, over effective members
    (core and risk); teams without any are dropped."""
    m = members if "tier" in members.columns else team_tiers(members)
    core, effective = F.col("tier") == "core", F.col("tier") != "peripheral"
    # Label counts and weights are over effective members.
    role, style, state = (F.when(effective, F.col(f"{a}.name")) for a in ("role", "style", "state"))
    w = F.when(effective, F.greatest(F.col("impact") / 100, F.lit(0.1)))
    share = lambda hit: F.coalesce(F.sum(F.when(hit, w)) / F.sum(w), F.lit(0.0))
    top = F.max_by(F.struct("production", "author"), F.when(core, F.struct(F.col("production"), F.lit(1))))
    columns = [
        F.count_if(core).alias("core_members"),
        F.count_if(effective).alias("effective_members"),
        F.count("*").alias("total_members"),
        F.max("repos").alias("repos"),
        *(F.coalesce(F.avg(F.when(core, F.col(a))), F.lit(0.0)).alias(f"avg_{a}") for a in AVERAGES),
        F.coalesce(F.stddev_pop(F.when(core, F.col("quality"))), F.lit(0.0)).alias("quality_stdev"),
        *(F.count_if(role == r).alias(f"n_{r}") for r in ROLES),
        *(F.count_if(style == s).alias(f"n_{s}") for s in STYLES),
        *(F.count_if(state == s).alias(f"n_{s}") for s in STATES),
        F.count_if(role == NONE).alias("n_none"),
        *(share(role == r).alias(f"w_{r}") for r in ROLES),
        *(share(style == s).alias(f"w_{s}") for s in STYLES),
        share(state == "Active").alias("w_Active"),
        F.count_if((role == "Architect") & (style == "Builder")).alias("n_building_architects"),
        top.alias("top"),
        F.array_sort(F.collect_list(F.when(effective, F.struct((-F.col("gravity")).alias("g"), "author", "robust_survival")))).alias("by_gravity"),
    ]
    return m.groupBy("team", "domain").agg(*columns).where("effective_members > 0")


def team_health(t: DataFrame) -> DataFrame:
    c, n = F.col, F.col("effective_members")
    has = lambda x: c(f"n_{x}") > 0
    bonus = lambda x, v: F.when(has(x), float(v)).otherwise(0.0)
    known = sum((F.when(has(r), 1).otherwise(0) for r in ROLES), F.lit(0))
    risk = c("n_Former") + c("n_Silent") + c("n_Fragile")
    base, k = c("avg_production"), c("core_members")
    density = F.when(k == 0, 0.0).when((k <= 3) & (base >= 50), base * 1.2).when((k <= 5) & (base >= 50), base * 1.1).otherwise(base)
    even = F.when(k < 2, c("avg_quality")).otherwise(c("avg_quality") * 0.6 + clamp(100 - c("quality_stdev") * 2, 0, 100) * 0.4)
    aar = F.when(~has("Architect"), 0.0).when(~has("Anchor"), -1.0).otherwise(c("n_Architect") / c("n_Anchor"))
    return t.withColumns(
        {
            "complementarity": clamp(known / 5.0 * 80 + bonus("Architect", 10) + bonus("Anchor", 5) + bonus("Cleaner", 5), 0, 100),
            "growth_potential": clamp(c("n_Growing") / n * 60 + bonus("Builder", 20) + bonus("Cleaner", 20), 0, 100),
            "sustainability": clamp((1 - risk / n) * 80 + bonus("Architect", 20), 0, 100),
            "debt_balance": clamp(c("avg_debt_cleanup"), 0, 100),
            "productivity_density": clamp(density, 0, 100),
            "quality_consistency": clamp(even, 0, 100),
            "risk_ratio": clamp(risk / n * 100, 0, 100),
            "aar": aar,
            "anchor_density": c("n_Anchor") / n,
            "architecture_coverage": (c("n_Architect") + c("n_Anchor")) / n,
        }
    )


def _r(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(0.0)


def structure_rules() -> list[tuple[str, Column]]:
    c, n = F.col, F.col("effective_members")
    arch, anchors, none, aar = c("n_Architect"), c("n_Anchor"), c("n_none") / n, c("aar")
    wa, wn = c("w_Architect"), c("w_Anchor")
    return [
        ("Architectural Engine", _r((arch >= 1) & (anchors >= 2) & aar.between(0.3, 0.8) & (none <= 0.4), clamp(F.least(wa * 3, wn * 2), 0, 1))),
        ("Architectural Team", _r((arch >= 1) & (anchors >= 1) & (none <= 0.4), clamp(F.least(wa * 2.5, wn * 2), 0, 0.9))),
        ("Architecture-Heavy", _r((arch >= 1) & (aar > 2) & (c("n_building_architects") < arch), clamp(wa * 2, 0, 0.85))),
        ("Emerging Architecture", _r((arch >= 1) & (none > 0.4), clamp(wa * 2, 0, 0.85))),
        ("Delivery Team", _r(c("n_Producer") / n >= 0.5, c("w_Producer"))),
        ("Maintenance Team", _r((arch == 0) & (anchors / n >= 0.4), wn)),
        ("Unstructured", _r(none > 0.5, none)),
        ("Balanced", F.lit(0.30)),
    ]


def culture_rules() -> list[tuple[str, Column]]:
    c = F.col
    w = lambda x: c(f"w_{x}")
    calm, fire = w("Balanced") + w("Resilient"), w("Rescue") + w("Churn")
    return [
        ("Builder", _r(w("Builder") >= 0.15, clamp(w("Builder") * 1.2, 0, 1))),
        ("Stability", _r(calm >= 0.5, calm * 0.9)),
        ("Mass Production", _r(w("Mass") >= 0.3, w("Mass"))),
        ("Firefighting", _r(fire >= 0.2, fire)),
        ("Evolving", _r((w("Builder") >= 0.1) & (w("Emergent") >= 0.1), clamp((w("Builder") + w("Emergent")) * 1.2, 0, 1))),
        ("Exploration", _r(w("Spread") >= 0.2, w("Spread"))),
        ("Mixed", F.lit(0.25)),
    ]


def phase_rules() -> list[tuple[str, Column]]:
    c, n = F.col, F.col("effective_members")
    g, a, r = c("n_Growing") / n, c("n_Active") / n, (c("n_Former") + c("n_Silent") + c("n_Fragile")) / n
    wa, arch, imp = c("w_Active"), c("n_Architect") > 0, c("avg_impact")
    return [
        ("Emerging", _r(g >= 0.4, presence(g))),
        ("Scaling", _r((g >= 0.2) & (g < 0.4), F.least(presence(g), health_high(c("growth_potential"))))),
        ("Mature", _r(a >= 0.8, F.least(presence(wa), health_high(c("sustainability"))))),
        ("Stable", _r(a >= 0.6, wa * 0.3 + 0.5)),
        ("Legacy-Heavy", _r((r >= 0.3) & (imp >= 40) & arch, F.least(presence(r), axis_high(imp)))),
        ("Mature with Attrition", _r((r >= 0.2) & (r < 0.4) & (a >= 0.4), F.least(presence(r) * 0.8, wa * 0.3 + 0.5))),
        ("Declining", _r(r >= 0.3, presence(r) * F.when((imp >= 40) & arch, 0.5).otherwise(1.0))),
        ("Rebuilding", _r((g >= 0.1) & (r >= 0.1), F.least(presence(g), presence(r)))),
    ]


def risk_rules() -> list[tuple[str, Column]]:
    c, n = F.col, F.col("effective_members")
    return [
        ("Bus Factor", _r(n <= 5, F.least(axis_high(c("avg_indispensability")), 1 - n / 10.0))),
        ("Design Vacuum", _r(c("n_Architect") == 0, 1 - c("complementarity") / 100)),
        ("Quality Drift", _r(c("quality_consistency") <= 60, 1 - c("quality_consistency") / 100)),
        ("Debt Spiral", _r(c("debt_balance") <= 45, 1 - c("debt_balance") / 100)),
        ("Talent Drain", _r(c("risk_ratio") >= 25, c("risk_ratio") / 100)),
        ("Healthy", F.lit(0.30)),
    ]


def character_rules() -> list[tuple[str, Column]]:
    c = F.col
    s, u, p = (c(x) for x in ("structure.name", "culture.name", "phase.name"))
    sc, uc, pc = (c(x) for x in ("structure.conf", "culture.conf", "phase.conf"))
    cov, density, aar = c("architecture_coverage"), c("productivity_density"), c("aar")
    built = (c("n_Architect") > 0) & (c("n_building_architects") == c("n_Architect"))
    engine = s.isin("Architectural Engine", "Architectural Team")
    both = F.least(sc, uc)
    return [
        ("Spiral", _r((cov > 0.4) & (density > 35) & (aar >= 0.3) & ((aar <= 0.8) | built), clamp(cov + density / 100, 0, 1))),
        ("Elliptical", _r(engine & (u == "Stability"), both)),
        ("Starburst", _r((engine | (s == "Emerging Architecture")) & (u == "Builder"), both)),
        ("Nebula", _r(u == "Builder", F.when(p.isin("Scaling", "Emerging"), F.least(uc, pc)).otherwise(uc * 0.5))),
        ("Irregular", _r((density > 40) & (cov < 0.2), clamp(density / 100 + 0.3, 0, 0.85))),
        ("Cluster", _r(s == "Delivery Team", F.when(u == "Mass Production", both).otherwise(sc * 0.6))),
        ("Collision", _r(u == "Firefighting", uc)),
        (
            "Dwarf",
            F.when((s == "Maintenance Team") & u.isin("Stability", "Mixed"), F.least(sc, F.lit(0.70)))
            .when((cov > 0.5) & (density < 20), 0.65)
            .otherwise(0.0),
        ),
        ("Filament", _r(u == "Exploration", uc * 0.8)),
        ("Lenticular", F.lit(0.25)),
    ]


def team_labels(t: DataFrame) -> DataFrame:
    """team_health rows with structure, culture, phase, risk and (from their rounded confidences) character."""
    out = t.withColumns({k: pick_best_label(r()) for k, r in (("structure", structure_rules), ("culture", culture_rules), ("phase", phase_rules), ("risk", risk_rules))})
    return out.withColumn("character", pick_best_label(character_rules()))


def team_warnings(t: DataFrame) -> DataFrame:
    """Adds warnings: the ordered texts of what is structurally wrong; without core members only that."""
    c = F.col
    # floor(x + 0.5) and not format_string: percentages print without a fraction, halves to the even neighbour.
    pct = lambda x: F.bround(x, 0).cast("long").cast("string")
    k, repos = c("core_members"), c("repos")
    total = c("avg_production") * k
    share = c("top.production") / F.nullif(total, F.lit(0.0)) * 100
    say = lambda ok, *parts: F.when(ok, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    text = lambda x: x.cast("string")
    first, second = F.try_element_at("by_gravity", F.lit(1)), F.try_element_at("by_gravity", F.lit(2))
    gap = F.coalesce(-first["g"] + second["g"], -first["g"])
    fixed = [
        say((k <= 3) & (repos >= 5), text(k), " core members carrying ", text(repos), " repos — high bus factor risk"),
        F.coalesce(
            say(c("risk_ratio") >= 40, pct(c("risk_ratio")), "% risk ratio — ", text(c("effective_members") - k), " of ", text(c("effective_members")), " effective members are Former/Silent/Fragile"),
            say(c("risk_ratio") >= 25, pct(c("risk_ratio")), "% risk ratio — approaching danger zone"),
        ),
        say((k >= 2) & (share >= 45), "Top contributor (", c("top.author"), ") accounts for ", pct(share), "% of core production — ProdDensity drops to ", pct((total - c("top.production")) / F.nullif(k - 1, F.lit(0))), " without them"),
        say(c("n_Silent") >= 2, text(c("n_Silent")), " Silent members — headcount says ", text(c("total_members")), " but effective contributors are ", text(k)),
        say((c("n_Architect") == 0) & (repos >= 3), "No Architect across ", text(repos), " repos — design decisions are implicit and unguarded"),
        say((-first["g"] >= 80) & (first["robust_survival"] < 50) & (gap >= 30), "Fragile gravity center — ", first["author"], " (Grav ", pct(-first["g"]), ", RobustSurv ", pct(first["robust_survival"]), ") concentrates structural influence without durability"),
    ]
    each = F.transform(
        F.filter("by_gravity", lambda m: (-m["g"] >= 50) & (m["robust_survival"] < 20)),
        lambda m: F.concat(F.lit("Fragile gravity — "), m["author"], F.lit(" (Grav "), pct(-m["g"]), F.lit(") has high influence but low robust survival ("), pct(m["robust_survival"]), F.lit(")")),
    )
    last = say((c("n_Architect") > 0) & (c("architecture_coverage") < 0.25), "Architect gravity exists but structural coverage remains low (", pct(c("architecture_coverage") * 100), "%)")
    every = F.concat(F.array_compact(F.array(*fixed)), each, F.array_compact(F.array(last)))
    none = F.array(F.lit("No core contributors — team has no active members above contribution threshold"))
    return t.withColumn("warnings", F.when(k == 0, none).otherwise(every))


def label_distribution(members: DataFrame, by=("team",)) -> DataFrame:
    """(.., axis, label, n) over effective members."""
    m = members if "tier" in members.columns else team_tiers(members)
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}.name").alias("label")) for a in ("role", "style", "state")))
    return m.where("tier <> 'peripheral'").select(*by, F.explode(axes).alias("x")).groupBy(*by, "x.axis", "x.label").agg(F.count("*").alias("n"))


def top_share(members: DataFrame) -> DataFrame:
    """The top producer's share of a team's core production, and the others' mean."""
    core = (members if "tier" in members.columns else team_tiers(members)).where("tier = 'core'")
    out = core.groupBy("team").agg(F.max("production").alias("top"), F.sum("production").alias("total"), F.count("*").alias("core"))
    return out.select("team", "core", (F.col("top") / F.nullif("total", F.lit(0)) * 100).alias("share"), ((F.col("total") - F.col("top")) / F.nullif(F.col("core") - 1, F.lit(0))).alias("rest"))


def gravity_gap(members: DataFrame, by=("team",)) -> DataFrame:
    """Largest gravity minus the second, or itself when alone."""
    w = Window.partitionBy(*by).orderBy(F.desc("gravity"), "author")
    rows = members.withColumn("next", F.lead("gravity").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select(*by, "author", (F.col("gravity") - F.coalesce("next", F.lit(0.0))).alias("gap"))
