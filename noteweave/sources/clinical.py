"""The clinical graph schema: types of sections, chunks, nodes and edges, and what an edge may connect."""

from __future__ import annotations

# They must equal those of the notes' schema for right results.
SECTION_TYPES = (
    "general_info", "chief_complaint", "present_illness", "past_medical_history", "medication_history", "exposure_history", "allergy_history", "family_history",
    "physical_exam", "imaging_findings", "pulmonary_function", "laboratory_findings", "pathology_findings", "initial_diagnosis", "treatment_plan", "progress_note",
)
CHUNK_TYPES = ("temporal_episode", "exam_item", "medication_entry", "procedure_entry", "exposure_entry", "clinical_state", "diagnosis_entry")
NODE_TYPES = (
    "PATIENT", "SEX", "AGE", "OCCUPATION", "BIRTHPLACE", "GENERAL_HEALTH_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE",
    "SYMPTOM", "SIGN", "VITAL_SIGN", "QUALIFIER", "FUNCTIONAL_STATUS",
    "DISEASE", "DISEASE_SUBTYPE", "DIAGNOSIS_ASSERTION", "DIAGNOSIS_BASIS", "ALLERGY", "FAMILY_HISTORY_ITEM", "PATHOGEN_OR_INFECTION",
    "TIME_REF", "DURATION", "FREQUENCY", "CLINICAL_EVENT", "ENCOUNTER_LOCATION",
    "TRIGGER", "EXPOSURE", "EXPOSURE_AMOUNT", "EXPOSURE_DURATION", "HABIT", "PATHOGEN", "VACCINATION",
    "DRUG", "DRUG_DOSE", "DRUG_ROUTE", "DRUG_FREQUENCY", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "MEDICATION_ADHERENCE", "TREATMENT_PLAN", "TREATMENT_RESPONSE",
    "EXAM_TEST", "LAB_TEST", "LAB_RESULT", "BLOOD_GAS_METRIC", "BLOOD_GAS_RESULT", "AUTOANTIBODY", "IMAGING_FINDING", "IMAGING_PATTERN", "PFT_METRIC", "PFT_RESULT",
    "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "BODY_SITE", "SEVERITY",
)
# Sentences that the rules write into graphs; they must equal those of the notes' rules.
PROTECTED_NOTE = ("受保护医学实体边界，类型倾向为 ", "，不得再拆分。")
SUBJECT_NOTE = "本段一般状态记录所描述的病例主体。"
ITEM_NOTE = "一般状态观察项目。"
VALUE_NOTE = "一般状态观察项目的取值。"
HAS_ITEM = ("患者有一般状态观察项目：", "。")
HAS_VALUE = ("的状态取值为", "。")
HAS_SITE = ("涉及的解剖部位是", "。")
SITE_REASON = "代码规则：部位 + 受保护医学实体，补充操作与部位的定位关系。"
TIME_REASON = "代码规则：时间参照位于受保护操作实体左侧，补充操作发生时间。"
STATUS_REASON = "代码规则：一般状态断言标准化为 item-value 结构。"
MOVED_REASON = ("代码规则将省略主语的 patient-centric 关系重锚到隐式患者节点；原 source=", "。")
ANCHOR_REASON = ("代码规则：", " 节点默认归属于病例主体，补充患者锚点关系。")
# Edge type, types of its source, types of its target; they must equal those of the notes' schema.
CLINICAL_EDGES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "HAS_SEX": (("PATIENT",), ("SEX",)),
    "HAS_AGE": (("PATIENT",), ("AGE",)),
    "HAS_OCCUPATION": (("PATIENT",), ("OCCUPATION",)),
    "HAS_BIRTHPLACE": (("PATIENT",), ("BIRTHPLACE",)),
    "HAS_GENERAL_STATUS": (("PATIENT",), ("GENERAL_HEALTH_STATUS",)),
    "HAS_STATUS_ITEM": (("PATIENT",), ("GENERAL_STATUS_ITEM",)),
    "STATUS_VALUE_IS": (("GENERAL_STATUS_ITEM",), ("GENERAL_STATUS_VALUE",)),
    "HAS_SYMPTOM": (("PATIENT", "CLINICAL_EVENT", "TIME_REF"), ("SYMPTOM",)),
    "SYMPTOM_ONSET": (("PATIENT", "CLINICAL_EVENT", "TIME_REF"), ("SYMPTOM",)),
    "HAS_SIGN": (("PATIENT", "EXAM_TEST"), ("SIGN",)),
    "HAS_VITAL_SIGN": (("PATIENT",), ("VITAL_SIGN",)),
    "HAS_FUNCTIONAL_STATUS": (("PATIENT",), ("FUNCTIONAL_STATUS",)),
    "NEGATED_FINDING": (("PATIENT", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY"), ("SYMPTOM", "SIGN", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "ALLERGY")),
    "SYMPTOM_WORSENS_WITH": (("SYMPTOM", "FUNCTIONAL_STATUS"), ("TRIGGER", "QUALIFIER", "CLINICAL_EVENT", "FUNCTIONAL_STATUS")),
    "SYMPTOM_RELIEVES_WITH": (("SYMPTOM",), ("DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY", "QUALIFIER", "TREATMENT_RESPONSE")),
    "WORSENS_AT_OR_FOR": (("SYMPTOM", "DISEASE", "FUNCTIONAL_STATUS"), ("TIME_REF", "DURATION")),
    "WORSENS_WITH": (("SYMPTOM", "DISEASE", "FUNCTIONAL_STATUS"), ("TRIGGER", "QUALIFIER", "CLINICAL_EVENT", "FUNCTIONAL_STATUS")),
    "RELIEVES_WITH": (("SYMPTOM", "DISEASE"), ("DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY", "QUALIFIER")),
    "ACCOMPANIED_BY": (("SYMPTOM", "SIGN", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION"), ("SYMPTOM", "SIGN", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "QUALIFIED_BY": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "AUTOANTIBODY", "DRUG", "TREATMENT_PLAN"), ("QUALIFIER", "SEVERITY", "FREQUENCY")),
    "QUANTITY_OF": (("QUALIFIER",), ("SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT")),
    "COLOR_OF": (("QUALIFIER",), ("SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT")),
    "TEXTURE_OF": (("QUALIFIER",), ("SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT")),
    "TIMING_OF": (("QUALIFIER", "TIME_REF"), ("SYMPTOM", "SIGN", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN")),
    "LOCALIZES_TO": (("SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "PROCEDURE"), ("BODY_SITE",)),
    "MEASURED_VALUE_IS": (("EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY"), ("LAB_RESULT", "BLOOD_GAS_RESULT", "PFT_RESULT")),
    "SEVERITY_IS": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "AUTOANTIBODY"), ("SEVERITY",)),
    "OCCURS_AT": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "DRUG", "HABIT", "EXPOSURE", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "AUTOANTIBODY"), ("TIME_REF",)),
    "LASTS_FOR": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "DRUG", "HABIT", "EXPOSURE"), ("DURATION",)),
    "TEMPORAL_PRECEDES": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "DRUG", "HABIT", "EXPOSURE"), ("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "DRUG", "HABIT", "EXPOSURE")),
    "TRIGGERED_BY": (("SYMPTOM", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "EXAM_TEST", "TREATMENT_PLAN"), ("TRIGGER", "PATHOGEN_OR_INFECTION", "VACCINATION", "EXPOSURE")),
    "AFTER_EVENT": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "VITAL_SIGN", "FUNCTIONAL_STATUS", "GENERAL_STATUS_ITEM", "GENERAL_STATUS_VALUE", "CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "DRUG", "HABIT", "EXPOSURE"), ("CLINICAL_EVENT", "PROCEDURE", "OXYGEN_THERAPY", "CLINICAL_TRIAL", "CONSULTATION", "VACCINATION", "PATHOGEN_OR_INFECTION", "EXAM_TEST", "TREATMENT_PLAN", "TIME_REF")),
    "DIAGNOSED_WITH": (("PATIENT", "DIAGNOSIS_ASSERTION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "SUSPECTED_DIAGNOSIS": (("PATIENT", "DIAGNOSIS_ASSERTION", "IMAGING_FINDING"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "DIAGNOSIS_PENDING": (("PATIENT", "DIAGNOSIS_ASSERTION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "DIAGNOSIS_ASSERTS": (("DIAGNOSIS_ASSERTION",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "DIFFERENTIAL_FOR": (("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "SUPPORTED_BY": (("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION"), ("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY")),
    "CONTRADICTS": (("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY")),
    "DIAGNOSIS_CHANGED_TO": (("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "COMORBIDITY": (("PATIENT",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "HISTORY_OF": (("PATIENT",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "PROCEDURE", "ALLERGY", "FAMILY_HISTORY_ITEM")),
    "NEGATED_HISTORY_OF": (("PATIENT",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "PROCEDURE", "ALLERGY", "FAMILY_HISTORY_ITEM")),
    "CAUSED_BY": (("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "HABIT", "EXPOSURE", "PATHOGEN", "TRIGGER")),
    "INFECTION_WITH": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM"), ("PATHOGEN", "PATHOGEN_OR_INFECTION")),
    "UNDERWENT_EXAM": (("PATIENT",), ("EXAM_TEST",)),
    "HAS_RESULT": (("EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY"), ("LAB_RESULT", "BLOOD_GAS_RESULT", "PFT_RESULT")),
    "HAS_FINDING": (("EXAM_TEST", "BODY_SITE"), ("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT")),
    "EXAM_HAS_FINDING": (("EXAM_TEST",), ("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT")),
    "FINDING_LOCALIZES_TO": (("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("BODY_SITE",)),
    "PATTERN_IS": (("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("IMAGING_PATTERN",)),
    "COMPARED_TO_PRIOR": (("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "TIME_REF")),
    "INDICATES": (("SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
    "NORMAL_FINDING": (("EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("LAB_RESULT", "BLOOD_GAS_RESULT", "PFT_RESULT", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING")),
    "ABNORMAL_FINDING": (("EXAM_TEST", "LAB_TEST", "BLOOD_GAS_METRIC", "PFT_METRIC", "VITAL_SIGN", "AUTOANTIBODY", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT"), ("LAB_RESULT", "BLOOD_GAS_RESULT", "PFT_RESULT", "SIGN", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING", "ULTRASOUND_FINDING", "PATHOLOGY_FINDING")),
    "TREATED_WITH": (("PATIENT", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM"), ("DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY")),
    "MEDICATION_FOR": (("DRUG",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM")),
    "UNDERWENT": (("PATIENT",), ("PROCEDURE",)),
    "PROCEDURE_FOR": (("PROCEDURE", "OXYGEN_THERAPY", "CONSULTATION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM")),
    "DOSE_IS": (("DRUG",), ("DRUG_DOSE",)),
    "HAS_DOSE": (("DRUG",), ("DRUG_DOSE",)),
    "HAS_ROUTE": (("DRUG",), ("DRUG_ROUTE",)),
    "HAS_FREQUENCY": (("DRUG",), ("DRUG_FREQUENCY", "FREQUENCY")),
    "TREATMENT_FOR": (("DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY", "PROCEDURE", "CONSULTATION"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM")),
    "RESULTED_IN": (("DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY", "PROCEDURE", "CLINICAL_TRIAL"), ("TREATMENT_RESPONSE", "GENERAL_HEALTH_STATUS", "SYMPTOM")),
    "PARTICIPATED_IN": (("PATIENT",), ("CLINICAL_TRIAL",)),
    "HAS_ADHERENCE": (("PATIENT", "DRUG", "TREATMENT_PLAN", "OXYGEN_THERAPY"), ("MEDICATION_ADHERENCE",)),
    "RECEIVED_VACCINATION": (("PATIENT",), ("VACCINATION",)),
    "CONSULTED_FOR": (("CONSULTATION",), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "SYMPTOM")),
    "EXPOSED_TO": (("PATIENT",), ("EXPOSURE",)),
    "HAS_HABIT": (("PATIENT",), ("HABIT",)),
    "AMOUNT_IS": (("HABIT", "EXPOSURE"), ("EXPOSURE_AMOUNT",)),
    "DURATION_IS": (("HABIT", "EXPOSURE"), ("EXPOSURE_DURATION", "DURATION")),
    "RISK_FACTOR_FOR": (("HABIT", "EXPOSURE"), ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")),
}
