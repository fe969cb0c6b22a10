"""Rule cards for labour contracts, and their findings on fact tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.review import alias_mask

#: Id, title, aliases, question for the legal search, whether a review needs it.
CARDS = [
    ("LC-001", "合同主体与必备事项", ["parties", "party", "甲方", "乙方", "用人单位", "劳动者"], "劳动合同应载明哪些主体和必备事项", True),
    ("LC-002", "书面劳动合同与建立关系时间", ["written_contract", "contract_date", "签订日期", "入职日期", "建立劳动关系"], "未及时订立书面劳动合同的法律后果", True),
    ("LC-003", "合同期限", ["term", "contract_term", "合同期限", "起始日期", "终止日期", "固定期限", "无固定期限"], "劳动合同期限和期限类型", True),
    ("LC-004", "试用期与合同期限匹配", ["probation", "试用期"], "试用期的最长期间和约定限制", False),
    ("LC-005", "试用期工资", ["probation_salary", "试用期工资", "试用期薪资"], "试用期工资的最低保护标准", False),
    ("LC-006", "工资与支付方式", ["salary", "wage", "compensation", "工资", "薪酬", "月工资", "基本工资", "劳动报酬"], "劳动报酬约定与工资支付", True),
    ("LC-007", "工作内容与岗位", ["work_content", "job", "岗位", "工作内容", "职务"], "劳动合同工作内容和岗位约定", False),
    ("LC-008", "工作地点", ["work_location", "location", "工作地点", "工作地"], "劳动合同工作地点及变更安排", False),
    ("LC-009", "工作时间、休息休假和加班", ["work_hours", "hours", "工作时间", "工时", "加班", "休息", "休假"], "工作时间、加班审批与加班工资", True),
    ("LC-010", "社会保险", ["social_insurance", "social security", "社保", "社会保险", "五险"], "劳动合同社会保险约定和放弃缴纳条款", True),
    ("LC-011", "劳动合同变更", ["modification", "change", "变更", "调整工资", "单方调整"], "劳动合同变更是否需要协商一致", False),
    ("LC-012", "解除、终止与通知", ["termination", "dismissal", "解除", "终止", "辞职", "解雇"], "劳动合同解除终止的法定条件和通知", True),
    ("LC-013", "经济补偿与违法解除后果", ["compensation_after_termination", "经济补偿", "赔偿", "违法解除"], "劳动合同解除终止时的经济补偿和赔偿", False),
    ("LC-014", "培训服务期与违约金", ["training", "service_period", "培训", "服务期", "培训费"], "专项培训服务期和违约金范围", False),
    ("LC-015", "竞业限制", ["non_compete", "non-compete", "竞业", "竞业限制"], "竞业限制人员范围、期限和补偿", False),
    ("LC-016", "保密、知识产权与成果归属", ["confidentiality", "intellectual_property", "保密", "知识产权", "成果归属"], "保密义务和职务成果归属约定", False),
    ("LC-017", "争议解决与证据", ["dispute", "dispute_resolution", "争议", "仲裁", "诉讼"], "劳动争议处理路径和举证责任", False),
]
#: What a rule's joined values must match, and the finding then; an empty pattern means any text.
CONDITIONS = [
    ("LC-010", r"不缴|不买|放弃.*社保|自愿放弃.*社会保险|无需.*缴纳|全部由.*承担", "possible_conflict", "high"),
    ("LC-012", r"随时解除|任意解除|无理由解除|单方决定|无需通知", "possible_conflict", "high"),
    ("LC-011", r"单方.*调整|随意.*变更|可随时修改|以公司制度为准", "possible_conflict", "medium"),
    ("LC-009", r"不支付.*加班|无偿加班|无限制加班|加班费.*包含|不另行支付", "possible_conflict", "high"),
    ("LC-004", r"试用期[^\n]{0,20}(?:超过|大于|长达)\s*[六6七7八8九9一二三四五]\s*个?月", "possible_conflict", "medium"),
    ("LC-006", r"缺失|未提供|未知|待补充|面议|待定|空白|无", "missing_information", "unconfirmed"),
    ("LC-015", r"\S", "observation", "medium"),
    ("LC-014", r"违约金", "possible_conflict", "medium"),
]
SEPARATOR = "；"


def finding(rule: str, query: str, values: Column) -> Column:
    """Struct(rule_id, finding_type, risk_level, query) of a rule on its facts' joined values, or null."""
    out = F.lit(None)
    for _, pattern, kind, risk in reversed([c for c in CONDITIONS if c[0] == rule]):
        out = F.when(values.rlike(pattern), _struct(rule, kind, risk, query)).otherwise(out)
    return out


def _struct(rule: str, kind: str, risk: str, query: str) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("finding_type"), F.lit(risk).alias("risk_level"), F.lit(query).alias("query"))


def review_findings(facts: DataFrame, review: str = "review_id", order: str = "fact_id") -> DataFrame:
    """review, found: a row a review with the array of its findings (rule_id, finding_type, risk_level, query), one a rule at most.

    Rules match by category and name only. A required rule without any fact is missing information. Facts are matched once
    and move once, with a bit a rule; a review's facts of one rule are joined in order, which a review's size bounds. Values
    of rules without a condition stay where they are.
    """
    masked = alias_mask(facts, [(i, aliases) for i, _, aliases, _, _ in CARDS], F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("name", F.lit(""))))
    conditional = {i for i, *_ in CONDITIONS}
    has = lambda mask, bits: mask.bitwiseAND(F.lit(bits).cast("long")) != 0
    fact = F.struct(F.col(order).alias("o"), F.coalesce("value", F.lit("")).alias("v"), F.col("matched").alias("m"))
    kept = F.when(has(F.col("matched"), sum(1 << n for n, card in enumerate(CARDS) if card[0] in conditional)), fact)
    held = masked.select(review, "matched", kept.alias("fact")).groupBy(review).agg(F.sort_array(F.collect_list("fact")).alias("facts"), F.bit_or("matched").alias("matched"))
    joined = lambda bit: F.array_join(F.transform(F.filter("facts", lambda x: has(x["m"], bit)), lambda x: x["v"]), SEPARATOR)
    found = []
    for n, (rule, _, _, query, required) in enumerate(CARDS):
        said = finding(rule, query, joined(1 << n)) if rule in conditional else F.lit(None)
        none = _struct(rule, "missing_information", "unconfirmed", query) if required else F.lit(None)
        if required or rule in conditional:
            found.append(F.when(has(F.col("matched"), 1 << n), said).otherwise(none))
    return held.select(review, F.array_compact(F.array(*found)).alias("found"))


def findings(facts: DataFrame, review: str = "review_id", order: str = "fact_id") -> DataFrame:
    """review, rule_id, finding_type, risk_level, query: the findings of review_findings, a row each."""
    return review_findings(facts, review, order).select(review, F.inline("found"))


def in_scope(facts: DataFrame, review: str = "review_id") -> DataFrame:
    """review, in_scope: whether any fact speaks of labour."""
    said = F.lower(F.concat_ws(" ", "category", "name", "value"))
    return facts.groupBy(review).agg(F.bool_or(said.rlike("劳动|用人单位|试用期|社会保险|social|probation|employment")).alias("in_scope"))
