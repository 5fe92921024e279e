"""Rule packs: the tables that make the operators speak a language. All rules are data.

``GENERIC`` fits plain prose in several languages; ``ZH_CLINICAL`` Chinese clinical notes. A pack's larger
tables (edge types with their endpoint rules) come from the caller: ``endpoint_rules`` takes them as pairs
of sets and explodes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from noteweave.functions.text import LINE_ENDS, RARE_LINE_ENDS


@dataclass(frozen=True)
class Pack:
    """``sections``: (id, priority, expressions) in file order. ``cues``: (expression, type). ``lexicon``:
    (term, node type, source). ``suffixes``: (expression, node type, source). ``leading``: expressions that
    are stripped off the front of suffix matches, in order. ``status``: (expression, [(item, value)]) where an
    item or value that starts with ``$`` is a group."""

    name: str
    terminators: str
    soft_terminators: str = ""
    sections: tuple = ()
    default_first: str = ""
    inherit: bool = True
    cues: tuple = ()
    lexicon: tuple = ()
    suffixes: tuple = ()
    leading: tuple = ()
    sites: tuple = ()
    status: tuple = ()
    status_context: str = ""
    inner_tokens: tuple = ()
    composites: dict = field(default_factory=dict)
    subject: str = ""
    negation: dict = field(default_factory=dict)
    default_chunk_type: str = "clinical_state"
    #: Put before section expressions: classes such as digits in every script, say.
    flags: str = ""

    def sentence_pattern(self, possessive: bool = True, rare: str = RARE_LINE_ENDS) -> str:
        """Tiles a text: sentences with their closing marks (and a rarer line end), line ends by themselves.
        A soft terminator ends a sentence before white space only. The repeated group is possessive, for Java's
        matcher would recurse once for each repeat; engines that don't recurse take the same matches without. ``rare``: the
        rarer line ends that the text can hold."""
        hard, soft = self.terminators, self.soft_terminators
        body = f"[^{hard}{soft}{LINE_ENDS}{rare}]"
        if soft:
            on = f"[{soft}]+[^ \t{hard}{soft}{LINE_ENDS}{rare}]{body}*"
            one = f"{body}+(?:{on})*{'+' if possessive else ''}[{hard}{soft}]*[{rare}]?"
        else:
            one = f"{body}+[{hard}]*[{rare}]?"
        return f"{one}|[{hard}{soft}]+[{rare}]?|[{LINE_ENDS}{rare}]"


GENERIC = Pack(
    name="generic",
    terminators="!?",
    soft_terminators=".",
    sections=(
        ("license", 90, (r"[Ll]icen[sc]e|[Cc]opyright|rights reserved",)),
        ("secret", 95, (r"token|secret|password|api_key", r"AKIA[0-9A-Z]{16}")),
        ("contact", 85, (r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}")),
        ("table", 80, (r"\|",)),
        ("junk", 80, (r"[#$%&*]{3}",)),
    ),
    default_first="prose",
    cues=(
        (r"with [a-z]+", "accompaniment"),
        (r"without [a-z]+|ohne [a-zäöüß]+|sin [a-zñáéíóú]+", "absence_trigger"),
        (r"from [a-z]+ [a-z]+", "origin"),
        (r"not [a-z]+|nicht [a-zäöüß]+|pas [a-zéèêàç]+", "denial"),
    ),
    lexicon=(
        ("with the", "BODY_SITE", "site_lexicon"), ("from the", "BODY_SITE", "site_lexicon"), ("on the", "BODY_SITE", "site_lexicon"),
        ("the", "SYMPTOM", "lexicon"), ("that", "DRUG", "lexicon"), ("was", "TIME_REF", "lexicon"), ("for", "PROCEDURE", "lexicon"),
        ("nicht", "DISEASE", "lexicon"), ("pour", "SYMPTOM", "lexicon"), ("para", "DRUG", "lexicon"), ("License", "DISEASE", "lexicon"),
    ),
    suffixes=((r"[a-z]{2,12}ation", "PROCEDURE", "suffix"), (r"[a-z]{2,12}ness", "SYMPTOM", "suffix"), (r"[a-z]{2,12}tionti", "PROCEDURE", "suffix")),
    leading=(r"[0-9]+ *days? ago", r"(?:the|and|of)", r"(?:with|from)"),
    sites=("with the", "from the", "on the"),
    status=((r"(the|that) +(is|was)", (("$1", "$2"),)), (r"(?:and|or) +(one|two|of)", (("and", "$1"), ("or", "$1")))),
    status_context="with",
    inner_tokens=("the", "on"),
    subject="that",
    negation={
        "triggers": ("not", "no", "without", "pas", "nicht", "ohne", "sin"),
        "terminators": ("etc",),
        "breakers": ("but", "aber", "mais", "pero"),
        "separators": (",",),
        "boundaries": (".", ";", "!", "?", "\n"),
        "clause_stops": ".;",
        "lead": ",: ",
        "whole_words": True,
    },
)

# They must equal those of the notes' rule files for right results.
ZH_CLINICAL = Pack(
    name="zh_clinical",
    flags="(?U)",
    terminators="。！？!?",
    sections=(
        ("patient_profile", 50, (r"^患者[,，]\s*(男|女)[,，]\s*\d+\s*岁", r"一般健康状况[：:]", r"(职业|文化程度|婚姻|籍贯)[：:]")),
        ("chief_complaint", 90, (r"主因[“\"《].*?[”\"》].*?(入院|就诊|来诊)", r"主诉[：:]")),
        ("relevant_history", 80, (r"^既往", r"既往.{0,8}(史|健康|体健|疾病|用药)", r"\d+\s*(年|月)前.{0,15}(术|外伤|骨折|手术)", r"(个人史|家族史|婚育史|月经史|过敏史|手术史)[：:]", r"(吸烟|饮酒|粉尘|霉菌|鸟类|职业暴露)史")),
        ("present_illness", 85, (r"患者(于|自)?\s*\d+\s*(年|月|天|周|小时)前", r"\d+\s*(年|月|天|周|小时)前.{0,20}(出现|反复|加重|发作|起病|无明显诱因)", r"现病史[：:]", r"^病程中", r"\d+\s*(月|天|年|周)前.{0,8}再次")),
        ("auxiliary_exam", 95, (r"入院后.{0,8}(完善|查|行|进行).*?检查", r"辅助检查[：:]", r"^(胸部CT|肺部CT|HRCT|胸片|X线)", r"^(血常规|生化|肝功|肾功|血气|凝血|D[-－]?二聚体|D2聚体|血沉|CRP)", r"^(肺功能|通气功能|换气功能|脉冲振荡)", r"^(支气管镜|BALF|病理|结核.*T细胞)", r"^[A-Z]?\d+[\.、]\s*(通气|换气|脉冲|弥散)")),
        ("physical_exam", 85, (r"入院查体[：:]", r"体格检查[：:]", r"查体[：:]")),
        ("initial_diagnosis", 85, (r"入院诊断[：:]", r"初步诊断[：:]", r"门诊诊断[：:]")),
        ("management_plan", 80, (r"诊疗?(计划|方案)[：:]", r"(拟|计划|建议).*?(完善|复查|随访|会诊|出院)")),
    ),
    default_first="patient_profile",
    cues=(
        (r"无明显诱因", "absence_trigger"), (r"无明显变化", "stable_status_value"), (r"无特殊不适", "stable_status_value"),
        (r"未规律[^，。；\n]*(?:口服药物|服药|用药)[^，。；\n]*", "medication_nonadherence"),
        (r"未予[^，。；\n]*(?:重视|诊疗|治疗|处理|用药|吸氧)[^，。；\n]*", "care_not_performed"),
        (r"未(?:行|查|复查|完善)[^，。；\n]*", "exam_or_procedure_not_performed"),
        (r"(?:无法|不能)[^，。；\n]*", "functional_limitation"),
        (r"(?:考虑|可能|倾向|待排|待诊)[^，。；\n]*", "uncertainty"),
        (r"(?:既往|曾|目前|入院后|病程中|术后|出院时)", "temporality"),
    ),
    lexicon=(
        *((s, "BODY_SITE", "body_site_lexicon") for s in ("双肺下叶基底段", "右肺中叶", "右肺下叶", "左肺舌段", "双肺下叶", "双下肢", "左下肢", "右下肢", "左膝关节", "右膝关节", "口唇", "甲床", "双肺", "左肺", "右肺")),
        *((t, k, "medical_lexicon") for t, k in (
            ("沙库巴曲缬沙坦片", "DRUG"), ("二甲双胍格列本脲片", "DRUG"), ("甲泼尼龙", "DRUG"), ("吡非尼酮", "DRUG"), ("骨折固定术", "PROCEDURE"), ("关节置换术", "PROCEDURE"), ("左膝关节置换术", "PROCEDURE"), ("支气管镜", "PROCEDURE"), ("CAStem细胞注射液输注", "PROCEDURE"), ("间质性肺炎", "DISEASE"), ("肺部感染", "PATHOGEN_OR_INFECTION"), ("新冠病毒感染", "PATHOGEN_OR_INFECTION"), ("右束支传导阻滞", "ECG_FINDING"), ("中度弥散功能障碍", "PFT_RESULT"), ("轻度阻塞性通气功能障碍", "PFT_RESULT"))),
    ),
    suffixes=(
        (r"[一-龥A-Za-z0-9-]{2,24}(?:片|胶囊|注射液|颗粒|滴丸|喷雾剂)", "DRUG", "drug_suffix"),
        (r"[一-龥A-Za-z0-9-]{1,12}(?:固定术|置换术|切除术|活检术|修复术|成形术|输注|注射|支气管镜)", "PROCEDURE", "procedure_suffix"),
    ),
    leading=(r"\d+\s*(?:年|月|天|周|小时)前", r"(?:既往|曾|目前|入院后|病程中)", r"(?:口服|静滴|吸入|给予|予以)"),
    sites=("双肺下叶基底段", "左膝关节", "右膝关节", "右肺中叶", "右肺下叶", "左肺舌段", "双肺下叶", "双下肢", "左下肢", "右下肢", "口唇", "甲床", "双肺", "左肺", "右肺"),
    status=(
        (r"(神志)\s*(清)", (("$1", "$2"),)), (r"(精神)\s*(可)", (("$1", "$2"),)), (r"(意识)\s*(清)", (("$1", "$2"),)),
        (r"(大小便)\s*(正常)", (("$1", "$2"),)), (r"(二便)\s*(正常)", (("$1", "$2"),)),
        (r"(饮食睡眠|饮食、睡眠|饮食及睡眠|饮食和睡眠)[^，。；\n]*正常", (("饮食", "正常"), ("睡眠", "正常"))),
        (r"(?:饮食睡眠、)?(大小便|二便)[^，。；\n]*正常", (("$1", "正常"),)),
        (r"(体重)\s*(无明显变化|稳定|未见明显变化)", (("$1", "$2"),)),
        (r"(一般健康状况)[:：]?\s*(良好|可|尚可)", (("$1", "$2"),)),
    ),
    status_context="病程中",
    inner_tokens=("骨折", "固定术", "置换术", "传导阻滞", "肺炎", "感染", "变化", "明显变化"),
    composites={"value": {"无明显变化": ("明显变化", "变化")}, "item": {"饮食": ("饮食睡眠",), "睡眠": ("饮食睡眠",)}},
    subject="患者",
    negation={
        "triggers": ("无", "未", "未见", "未诉", "未及", "未发现", "否认", "不伴", "无明显", "未予", "未行", "未查", "未复查", "无法", "不能"),
        "terminators": ("等不适", "等症状", "等情况", "等阳性体征", "等异常", "等"),
        "breakers": ("但", "但是", "然而", "除", "除外", "除此之外", "反而", "却"),
        "separators": ("、", "，", ","),
        "boundaries": ("。", "；", "!", "？", "\n"),
        "clause_stops": "，。；",
        "lead": "，、：: ",
        "whole_words": False,
    },
)

#: A small graph schema for prose: edge type -> (source types, target types).
GENERIC_EDGES = {
    "HAS_SYMPTOM": (("PATIENT",), ("SYMPTOM",)),
    "TREATED_WITH": (("PATIENT", "DISEASE", "SYMPTOM"), ("DRUG",)),
    "UNDERWENT": (("PATIENT",), ("PROCEDURE",)),
    "DIAGNOSED_WITH": (("PATIENT",), ("DISEASE",)),
    "NEGATED_FINDING": (("PATIENT",), ("SYMPTOM", "DISEASE")),
    "HISTORY_OF": (("PATIENT",), ("DISEASE",)),
    "LOCALIZES_TO": (("PROCEDURE", "SYMPTOM"), ("BODY_SITE",)),
    "OCCURS_AT": (("PROCEDURE", "SYMPTOM", "DISEASE"), ("TIME_REF",)),
    "RELATED_TO": (("SYMPTOM", "DRUG", "DISEASE"), ("SYMPTOM", "DRUG", "DISEASE")),
}


def section_rules(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(s, p, i, pack.flags + r) for i, (s, p, rs) in enumerate(pack.sections) for r in rs]
    return spark.createDataFrame(rows, "section_id string, priority int, rule_order int, regex string")


def lexicon(spark: SparkSession, pack: Pack) -> DataFrame:
    return spark.createDataFrame([(t, k, s) for t, k, s in pack.lexicon], "term string, node_type string, source string")


def endpoint_rules(spark: SparkSession, edges: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """One row for each allowed (edge type, source type, target type)."""
    rows = [(e, s, t) for e, (ss, ts) in edges.items() for s in ss for t in ts]
    return spark.createDataFrame(rows, "edge_type string, source_type string, target_type string")


def dimension(spark: SparkSession, kind: str, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(kind, n) for n in names], "kind string, name string")
