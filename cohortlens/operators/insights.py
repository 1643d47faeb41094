"""Graded insights and the recommendations that follow from them.

One grouped count over all category roles and one aggregate over all measures
feed every insight; what follows works on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bands import overall_severity, severity
from cohortlens.functions.numbers import text_to_number, to_number
from cohortlens.functions.text import format_money, format_pct
from cohortlens.functions.vocabulary import OVERTIME_NO, OVERTIME_YES
from cohortlens.operators.outcome import percent, role_level_rates
from cohortlens.operators.quantiles import exact_quantiles

# Insight groups in report order, the role each needs, and its title.
INSIGHTS = {
    "Overview": (None, "Tỷ lệ nghỉ việc tổng thể"),
    "Overtime": ("overtime", "Làm thêm giờ và nghỉ việc"),
    "Job Satisfaction": ("job_satisfaction", "Hài lòng công việc"),
    "Monthly Income": ("income", "Thu nhập và nghỉ việc"),
    "Years at Company": ("tenure", "Thâm niên tại công ty"),
    "Department": ("department", "Phòng ban nổi bật"),
    "Job Role": ("job_role", "Vị trí công việc rủi ro"),
    "Distance": ("distance", "Khoảng cách nhà – công ty"),
    "Performance": ("performance", "Đánh giá hiệu suất"),
}

# Problem, action and goal recommended for each insight group.
RECOMMENDATIONS = {
    "Overtime": ("Khối lượng làm thêm giờ",
                 "Rà soát OT policy, phân bổ workload và cân bằng thời gian làm việc.",
                 "Giảm attrition ở nhóm OT cao"),
    "Job Satisfaction": ("Hài lòng công việc thấp",
                         "Khảo sát engagement và cải thiện trải nghiệm công việc cho nhóm điểm thấp.",
                         "Tăng retention qua engagement"),
    "Monthly Income": ("Chênh lệch thu nhập",
                       "Rà soát khung lương/thưởng theo vị trí và benchmark thị trường.",
                       "Cân bằng compensation"),
    "Years at Company": ("Thâm niên ngắn",
                         "Tăng cường onboarding và mentoring giai đoạn đầu (0–2 năm).",
                         "Giảm early attrition"),
    "Department": ("Phòng ban rủi ro cao",
                   "Exit interview chuyên sâu, kiểm tra quản lý trực tiếp và workload phòng ban.",
                   "Ổn định phòng ban nóng"),
    "Job Role": ("Vị trí rủi ro cao",
                 "Phân tích career path và hỗ trợ phát triển cho vị trí có attrition cao.",
                 "Giữ chân theo role"),
    "Distance": ("Khoảng cách lớn", "Xem xét hybrid/flexible work hoặc hỗ trợ đi lại.", "Giảm ma sát đi lại"),
    "Performance": ("Hiệu suất và nghỉ việc",
                    "Đối chiếu đánh giá hiệu suất với lộ trình phát triển nghề nghiệp.",
                    "Giữ nhân sự theo performance band"),
    "Overview": ("Attrition tổng thể",
                 "Thiết lập dashboard theo dõi attrition định kỳ và cảnh báo nhóm rủi ro.",
                 "Giám sát liên tục"),
}

CATEGORY_ROLES = ["overtime", "job_satisfaction", "department", "job_role"]
MEASURE_ROLES = ["income", "tenure", "distance", "performance"]


def _level_facts(df: DataFrame, roles: dict[str, str], wanted: list[str], min_total: int) -> DataFrame:
    """One row: per category role the levels its insight is about."""
    levels = role_level_rates(df, {r: roles[r] for r in wanted}).withColumn("num", text_to_number(F.col("level")))
    rate, level, name = F.col("rate"), F.col("level"), F.lower("level")

    def of(role: str, condition: Column | None = None) -> Column:
        hit = F.col("role") == role
        return hit if condition is None else hit & condition

    row, best = F.struct("level", "rate", "leaving", "total"), F.struct(-rate, level)
    place = F.struct("num", "level")
    facts = {
        "overtime": lambda: [
            F.max(F.when(of("overtime", name.isin(OVERTIME_YES)), rate)).alias("yes"),
            F.max(F.when(of("overtime", name.isin(OVERTIME_NO)), rate)).alias("no"),
        ],
        "job_satisfaction": lambda: [
            F.min_by(row, F.when(of("job_satisfaction", level.isNotNull()), place)).alias("low"),
            F.max_by(row, F.when(of("job_satisfaction", level.isNotNull()), place)).alias("high"),
        ],
        "department": lambda: [F.min_by(row, F.when(of("department"), best)).alias("department")],
        # Groups with enough rows come first; without any, the best of all groups wins.
        "job_role": lambda: [F.min_by(row, F.when(of("job_role"), F.struct(F.col("total") < min_total, -rate, level))).alias("job_role")],
    }
    return levels.agg(*[a for r in wanted for a in facts[r]()])


def _metrics(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def _say(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def _finding(group: str, holds: Column, evidence: Column, difference: Column, grade: Column,
             metrics: dict[str, Column], text: Column) -> Column:
    return F.struct(
        F.lit(list(INSIGHTS).index(group)).alias("ord"), F.lit(group).alias("grp"),
        F.lit(INSIGHTS[group][1]).alias("title"), evidence.alias("evidence"), difference.alias("difference"),
        grade.alias("severity"), _metrics(metrics).alias("metrics"), text.alias("text"), holds.alias("holds"),
    )


def _overview() -> Column:
    rate, total = F.col("overall"), F.col("total")
    return _finding(
        "Overview", F.lit(True), format_pct(rate), _say("n=%d", total), overall_severity(rate),
        {"attrition_rate": rate, "n": total},
        _say("Trên %d nhân viên, tỷ lệ nghỉ việc là %s (%d người).", total, format_pct(rate), F.col("leaving")),
    )


def _overtime() -> Column:
    yes, no = F.col("f.yes"), F.col("f.no")
    diff = yes - no
    return _finding(
        "Overtime", diff.isNotNull(), _say("%.2f%% vs %.2f%%", yes, no), _say("%+.2f điểm %%", diff), severity(diff),
        {"rate_yes": yes, "rate_no": no, "diff": diff},
        _say("Nhóm làm thêm giờ có tỷ lệ nghỉ việc %s, nhóm không làm thêm là %s. Chênh lệch %+.2f điểm phần trăm.",
             format_pct(yes), format_pct(no), diff),
    )


def _satisfaction() -> Column:
    low, high = F.col("f.low.rate"), F.col("f.high.rate")
    diff = low - high
    return _finding(
        "Job Satisfaction", F.col("f.low.level") != F.col("f.high.level"), _say("%.2f%% vs %.2f%%", low, high),
        _say("%+.2f điểm %%", diff), severity(diff), {"low_rate": low, "high_rate": high},
        _say("Mức hài lòng %s: %s; mức %s: %s.", F.col("f.low.level"), format_pct(low), F.col("f.high.level"), format_pct(high)),
    )


def _department() -> Column:
    rate, overall, level = F.col("f.department.rate"), F.col("overall"), F.coalesce("f.department.level", F.lit("NULL"))
    diff = rate - overall
    return _finding(
        "Department", rate.isNotNull(), _say("%s: %.2f%%", level, rate), _say("%+.2f điểm %% vs overall", diff),
        severity(diff), {"rate": rate, "overall": overall},
        _say("`%s` có tỷ lệ %s (%d/%d), so với overall %s.", level, format_pct(rate), F.col("f.department.leaving"),
             F.col("f.department.total"), format_pct(overall)),
    )


def _job_role() -> Column:
    rate, level = F.col("f.job_role.rate"), F.coalesce("f.job_role.level", F.lit("NULL"))
    return _finding(
        "Job Role", rate.isNotNull(), format_pct(rate), _say("n=%d", F.col("f.job_role.total")),
        severity(rate - F.col("overall")), {"rate": rate},
        _say("`%s` có tỷ lệ nghỉ việc %s trên %d nhân viên.", level, format_pct(rate), F.col("f.job_role.total")),
    )


def _income() -> Column:
    e, o = F.col("e_income"), F.col("o_income")
    share = F.coalesce(F.try_divide((o - e) * 100, o), F.lit(0.0))
    return _finding(
        "Monthly Income", F.lit(True), F.concat(format_money(e), F.lit(" vs "), format_money(o)), format_money(F.abs(o - e)),
        severity(share), {"leave_mean": e, "stay_mean": o, "diff": o - e},
        _say("Thu nhập TB nhóm nghỉ: %s; nhóm ở lại: %s.", format_money(e), format_money(o)),
    )


def _tenure() -> Column:
    e, o = F.col("e_tenure"), F.col("o_tenure")
    return _finding(
        "Years at Company", F.lit(True), _say("%.2fy vs %.2fy", e, o), _say("%+.2f năm", e - o), severity((o - e) * 5),
        {"leave_mean": e, "stay_mean": o},
        _say("Nhóm nghỉ: mean %.2f (median %.2f); nhóm ở lại: mean %.2f (median %.2f).", e, F.col("m.e"), o, F.col("m.o")),
    )


def _distance() -> Column:
    e, o = F.col("e_distance"), F.col("o_distance")
    return _finding(
        "Distance", F.lit(True), _say("%.2f vs %.2f km", e, o), _say("%+.2f km", e - o), severity((e - o) * 3),
        {"leave_mean": e, "stay_mean": o}, _say("Khoảng cách TB nhóm nghỉ %.2f; nhóm ở lại %.2f.", e, o),
    )


def _performance() -> Column:
    e, o = F.col("e_performance"), F.col("o_performance")
    return _finding(
        "Performance", F.lit(True), _say("%.2f vs %.2f", e, o), _say("%+.2f", e - o), severity((o - e) * 10),
        {"leave_mean": e, "stay_mean": o}, _say("Hiệu suất TB — nghỉ: %.2f; ở lại: %.2f.", e, o),
    )


def insights(df: DataFrame, roles: dict[str, str], only: list[str] | None = None, min_total: int = 20) -> DataFrame:
    """(ord, grp, title, evidence, difference, severity, metrics, text).

    ``only`` limits the work to some groups; groups whose role is absent give no row.
    """
    groups = [g for g in INSIGHTS if (only is None or g in only)
              and (INSIGHTS[g][0] is None or roles.get(INSIGHTS[g][0]) in df.columns)]
    needed = [INSIGHTS[g][0] for g in groups]
    categories = [r for r in needed if r in CATEGORY_ROLES]
    measures = [r for r in needed if r in MEASURE_ROLES]
    sides = {"e": F.col("event") == 1, "o": F.col("event") == 0}
    facts = df.agg(
        F.count(F.lit(1)).alias("total"), F.sum("event").alias("leaving"),
        percent(F.sum("event"), F.count(F.lit(1))).alias("overall"),
        *[F.avg(F.when(side, to_number(df, roles[r]))).alias(f"{s}_{r}") for r in measures for s, side in sides.items()],
    ).where("total > 0")
    if categories:
        packed = _level_facts(df, roles, categories, min_total)
        facts = facts.withColumn("f", packed.select(F.struct("*")).scalar())
    if "tenure" in measures:
        halves = exact_quantiles(df, {"tenure": to_number(df, roles["tenure"])}, [0.5], by="event")
        middle = halves.agg(F.struct(*[
            F.max(F.when(F.col("grp") == v, F.col("q")[0])).alias(s) for s, v in (("e", 1), ("o", 0))
        ])).scalar()
        facts = facts.withColumn("m", middle)
    build = {
        "Overview": _overview, "Overtime": _overtime, "Job Satisfaction": _satisfaction, "Monthly Income": _income,
        "Years at Company": _tenure, "Department": _department, "Job Role": _job_role, "Distance": _distance,
        "Performance": _performance,
    }
    return facts.select(F.inline(F.array(*[build[g]() for g in groups]))).where("holds").drop("holds")


def recommendations(found: DataFrame) -> DataFrame:
    """(ord, problem, evidence, recommended_action, priority, expected_goal, based_on, linked_insight).

    Low insights give none, except the overview.
    """
    rules = found.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(p).alias("problem"), F.lit(a).alias("recommended_action"),
                 F.lit(goal).alias("expected_goal"))
        for g, (p, a, goal) in RECOMMENDATIONS.items()
    ])))
    kept = found.where((F.col("grp") == "Overview") | (F.col("severity") != "LOW"))
    # Nine rules.
    return kept.join(F.broadcast(rules), "grp").select(
        "ord", "problem",
        F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.substring("text", 1, 160)).alias("evidence"),
        "recommended_action", F.col("severity").alias("priority"), "expected_goal",
        F.col("title").alias("based_on"), F.col("text").alias("linked_insight"),
    )


def risk_signals(found: DataFrame, n: int = 4) -> DataFrame:
    """First insights, in report order, that are not the overview and not low."""
    return found.where((F.col("grp") != "Overview") & F.col("severity").isin("HIGH", "MEDIUM")).orderBy("ord").limit(n)


def top_recommendations(recs: DataFrame, n: int = 3) -> DataFrame:
    return recs.orderBy("ord").limit(n)
