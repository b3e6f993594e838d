"""Default word lists, patterns and limits.

Every operator takes these as parameters, so a caller with documents in another
language or trade passes its own tables.
"""

from traceframe.functions.patterns import wide

# ---------------------------------------------------------------------------
# Categories, words, titles, patterns and formats that results
# have to agree on. Order matters: ties go to the earlier entry.
# ---------------------------------------------------------------------------

REQUIREMENT_LEXICON = {
    "format": ["技术标", "施工组织设计", "暗标", "明标", "格式", "目录", "页码", "字体", "签章", "装订"],
    "pass_fail": ["通过制", "合格制", "符合性", "响应性", "通过", "不通过", "否决", "废标", "实质性响应"],
    "schedule": ["工期", "进度", "节点", "开工", "完工", "总工期"],
    "quality": ["质量", "验收", "合格", "创优"],
    "safety": ["安全", "文明施工", "应急", "风险"],
    "environment": ["环保", "环境保护", "水土保持", "扬尘", "噪声"],
    "resources": ["项目经理", "技术负责人", "人员", "机械", "设备", "材料", "劳动力"],
    "water_scene": ["水利", "水电", "河道", "堤防", "水库", "泵站", "闸站", "水闸", "围堰", "导流", "度汛", "排水", "降水"],
}
SCENE_CATEGORIES = ["schedule", "quality", "safety", "environment", "resources", "water_scene"]
MANDATORY_MARKERS = [
    "必须", "应当", "应提供", "须提供", "须附", "不得", "严禁", "投标人应", "承包人应", "需提交",
    "技术标要求", "施工组织设计应",
]
CLAUSE_STRONG_WORDS = ["必须", "严禁", "不得", "禁止"]

SECTION_BY_CATEGORY = {
    "schedule": "施工进度计划及保证措施",
    "quality": "质量管理体系与保证措施",
    "safety": "安全生产、文明施工及应急措施",
    "environment": "环境保护与水土保持措施",
    "resources": "资源配置计划",
    "water_scene": "季节性施工、度汛及水利专项措施",
    "format": "编制说明及工程概况",
    "pass_fail": "编制说明及工程概况",
}
DEFAULT_SECTION = "主要施工方案与技术措施"
STANDARD_OUTLINE = [
    "编制说明及工程概况", "施工总体部署", "施工进度计划及保证措施", "主要施工方案与技术措施",
    "质量管理体系与保证措施", "安全生产、文明施工及应急措施", "环境保护与水土保持措施", "资源配置计划",
    "季节性施工、度汛及水利专项措施", "资料管理、验收配合及后续服务",
]
OUTLINE_THEMES = [
    (["泵站", "闸站", "水闸"], "泵站、水闸及机电设备安装调试措施"),
    (["河道", "堤防", "疏浚"], "河道治理、堤防及疏浚施工措施"),
    (["水库", "除险加固"], "水库工程及运行约束专项措施"),
]
OUTLINE_THEME_POSITION = 4
RESPONSE_STRATEGIES = {
    "format": "按招标文件格式要求编排目录、签章、页码、暗标/明标规则，提交前人工复核。",
    "pass_fail": "作为实质性响应项逐条覆盖，避免遗漏导致不通过。",
    "schedule": "写明总工期、关键节点、资源保障和纠偏措施，具体日期需人工确认。",
    "quality": "建立质量目标、组织体系、过程控制、验收资料和整改闭环。",
    "safety": "覆盖安全责任、风险辨识、专项方案、文明施工和应急处置。",
    "environment": "覆盖水土保持、扬尘噪声、弃土弃渣、污水和生态保护。",
    "resources": "列明人员、机械、材料和劳动力计划，数量型号需人工确认。",
    "water_scene": "补充水利专项施工措施，如围堰导流、度汛、排水降水、泵闸调试。",
}
DEFAULT_STRATEGY = "在相关施工组织章节中明确响应，不留空泛表述。"
HUMAN_CHECK_CATEGORIES = ["format", "resources", "schedule"]
HUMAN_CHECK_ITEMS = [
    "确认本项目技术标是否明确为通过制/合格制。",
    "确认暗标、签章、页码、字体、目录、装订等格式要求。",
    "确认工期、质量目标、人员设备、关键水利施工场景是否完整。",
]
CASE_STYLE_NOTES = [
    "优先使用已通过技术标中的章节顺序和稳健措辞。",
    "项目参数不明确时保留人工确认占位，不虚构。",
    "通过制正文强调完整响应、施工组织闭环和风险措施覆盖。",
]
CASE_SEARCH_WORDS = ["河道", "堤防", "泵站", "水闸", "水库", "疏浚", "护岸", "围堰", "导流"]
CASE_SEARCH_DEFAULT = "水利"
SECTION_ALIASES = {
    "编制说明及工程概况": "编制说明",
    "主要施工方案与技术措施": "主要施工方法与技术措施",
    "安全生产、文明施工及应急措施": "安全生产、文明施工与应急措施",
    "环境保护与水土保持措施": "环境保护与水土保持",
    "资源配置计划": "主要施工设备与检验仪器投入",
    "季节性施工、度汛及水利专项措施": "季节性施工、施工导流与度汛",
    "资料管理、验收配合及后续服务": "资料管理、验收配合与附件",
}

# References between places of a document.
REFERENCE_MARKER = r"(?:详见|参见|见|按|按照|以).{0,16}"
REFERENCE_PAGE = wide(r"(?:第\s*(\d{1,4})\s*页|[PＰpｐ]\s*[.．:：\-]?\s*(\d{1,4}))")
REFERENCE_TABLE = wide(
    r"投标人须知前附表|评标办法前附表|合同条款前附表|专用合同条款前附表|"
    r"附表\s*[一二三四五六七八九十百\dA-Za-z.\-—]*|表\s*\d+(?:[.．]\d+){0,4}"
)
REFERENCE_TAIL = wide(
    r"[（(]?\s*(?:详见|参见|见|按|按照).{0,100}?"
    r"(?:第\s*\d{1,4}\s*页|[PＰpｐ]\s*[.．:：\-]?\s*\d{1,4}|"
    r"投标人须知前附表|评标办法前附表|合同条款前附表|附表|表\s*\d).*?[）)]?\s*$"
)
REFERENCE_PUNCTUATION = " ：:；;，,。"
LABELLED_FACT_KEYS = ["项目名称", "建设地点", "质量目标"]
FACT_LABEL = r"^(?:项目|工程)?(?:名称|地点|质量目标|质量标准)"

# (key, pattern, has a unit group)
FACT_PATTERNS = [
    ("总工期", wide(r"(?:计划)?总工期[^\d]{0,12}(\d+(?:\.\d+)?)\s*(日历天|天|个月)"), True),
    ("计划工期", wide(r"计划工期[^\d]{0,12}(\d+(?:\.\d+)?)\s*(日历天|天|个月)"), True),
    ("质量目标", wide(r"质量(?:目标|标准)[：:\s]*([^。；\n|]{2,40})"), False),
    ("建设地点", wide(r"(?:建设|工程|项目)地点[：:\s]*([^。；\n|]{2,60})"), False),
    ("项目名称", wide(r"(?:项目|工程)名称[：:\s]*([^。；\n|]{2,80})"), False),
]
FACT_SUFFIXES = [".pdf", ".doc", ".docx", ".txt", ".md", ".xlsx"]
FACT_SECTION_WORDS = {
    "总工期": ["进度", "部署", "季节"],
    "计划工期": ["进度", "部署", "季节"],
    "质量目标": ["质量", "编制"],
    "建设地点": ["概况", "总平面"],
    "项目名称": ["编制", "概况"],
}
FACT_SECTION_DEFAULT = ["概况"]

STANDARD_WORDS = ["规范", "规程", "标准", "导则", "技术要求"]
STANDARD_CODE = wide(
    r"(?iu)((?:GB|GB/T|SL|SL/T|DL/T|JGJ|CJJ|JTG|NB/T|DB\d{2}/T?)\s*\d+(?:\.\d+)?(?:[-—–]\d{4})?)"
)
BOOK_TITLE = r"[《〈]([^》〉]{2,80})[》〉]"
# (code prefix, platform, address); the last entry is the fallback
OFFICIAL_SOURCES = [
    ("SL", "水利部及水利行业标准平台", "https://www.mwr.gov.cn/"),
    ("DB33", "浙江省政务公开及地方标准平台", "https://www.zj.gov.cn/"),
    ("", "国家标准全文公开系统", "https://openstd.samr.gov.cn/"),
]
OFFICIAL_HOSTS = ["gov.cn", "openstd.samr.gov.cn", "mwr.gov.cn", "zj.gov.cn"]
# (words in code or title, words in section titles)
STANDARD_SECTION_RULES = [
    (["质量", "验收", "检验"], ["质量", "材料", "试验"]),
    (["安全", "施工现场", "临时用电"], ["安全", "文明", "应急"]),
    (["水土保持", "环境"], ["环境", "水土保持"]),
    (["土方", "堤防", "水利水电"], ["施工方案", "施工方法", "技术"]),
]

CLAUSE_START = wide(
    r"^\s*(?:(第\s*[0-9一二三四五六七八九十百]+\s*条)|(\d+(?:\.\d+){1,5}))\s*[、.．:]?\s*(.*)$"
)
HEADING = wide(
    r"^\s*((第[一二三四五六七八九十百]+[章节篇])|([一二三四五六七八九十]+[、.．])|"
    r"(\d+([.．]\d+)*[、.．]?)|（[一二三四五六七八九十\d]+）)\s*(.+?)\s*$"
)
QUANTITY = wide(
    r"(?iu)(?<![A-Za-z0-9_.-])\d+(?:\.\d+)?\s*(?:日历天|天|小时|分钟|秒|个月|年|%|％|"
    r"mm|cm|m|km|m²|m2|㎡|m³|m3|立方米|平方米|kW|kw|MPa|kPa|kN|N|dB|℃|°C|台|套|辆|人|班|次)"
    r"(?![A-Za-z0-9_])"
)
CLAUSE_CITATION = wide(
    r"(?iu)(?:(?:GB|GB/T|SL|SL/T|DL/T|JGJ|CJJ|JTG|NB/T|DB\d{2}/T?)\s*\d+(?:\.\d+)?(?:[-—–]\d{4})?)"
    r"\s*(?:第\s*\d+(?:\.\d+)*\s*条|§\s*\d+(?:\.\d+)*)"
)
REVIEW_QUANTITY = wide(r"(?iu)\d+(?:\.\d+)?\s*(?:日历天|天|小时|分钟|mm|cm|m|km|%|％)")
CASE_PARAMETER = wide(
    r"(?iu)\d+(?:\.\d+)?\s*(?:日历天|天|个月|年|%|％|mm|cm|m|km|m²|m3|m³|kW|MPa|kPa|台|套|辆|人|班|次)"
)
CASE_PARAMETER_MASK = "【项目参数】"
QUANTITY_HEADERS = [
    "数量", "人数", "工程量", "日历天数", "天数", "工期", "持续时间", "平均人数", "高峰人数", "储备数量", "计划进场",
]
TABLE_QUANTITY = wide(r"^\d+(?:\.\d+)?(?:[-~～]\d+(?:\.\d+)?)?$")
COVERAGE_SPLIT = r"(?U)[，。；、\s]+"
COVERAGE_PLACEHOLDER = r"【[^】]*(?:待完善|人工确认|待确认)[^】]*】"
AUDIT_PLACEHOLDER = r"【[^】]*(?:待人工确认|待完善|待确认)[^】]*】"
UNCONFIRMED = "待人工确认"

# (role, confidence, words, extra suffixes, needed project kind); first match wins
ROLE_RULES = [
    ("design_report", 0.86, ["初步设计", "初设", "批复稿", "可研", "设计报告"], [], None),
    ("budget", 0.84, ["预算", "工程量清单", "招标控制价", "清单"], [], None),
    ("drawing", 0.84, ["图纸", "施工图", "总平", "平面图", "cad", "dwg", "dxf"], [".dwg", ".dxf"], None),
    ("standard", 0.78, ["规范", "规程", "标准", "导则"], [], None),
    ("tender", 0.92, ["招标", "招標", "招标文件", "tender", "zhaobiao"], [], None),
    (
        "accepted_bid", 0.88,
        ["技术标", "技術標", "投标文件", "投標文件", "施工组织设计", "已通过", "passed", "bid"], [], "passed_case",
    ),
    ("candidate_tender", 0.45, None, [], "new_tender"),
    ("attachment", 0.35, None, [], None),
]
ROLE_STRIP = r"(?U)[\s_\-（）()【】\[\]]+"
DOCUMENT_SUFFIXES = [
    ".pdf", ".docx", ".doc", ".txt", ".md", ".xlsx", ".xls", ".csv", ".png", ".jpg", ".jpeg", ".tif", ".tiff",
    ".dwg", ".dxf",
]
TEXT_SUFFIXES = [".txt", ".md", ".csv", ".json", ".yaml", ".yml"]
PRIMARY_SUFFIXES = [".pdf", ".doc", ".docx", ".txt", ".md"]
IGNORED_DIRS = ["outputs", "drawings", "assets", "__pycache__", ".git", ".cache"]
PASSED_ALIASES = ["passed_cases", "passed"]
NEW_ALIASES = ["new_tenders", "unpassed"]
VISUAL_ROLES = ["tender", "design_report", "budget", "drawing", "standard"]
VISUAL_SUFFIXES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".pdf", ".doc", ".docx", ".dxf"]
DRAWING_NAME_NOISE = r"(图纸|施工图|设计图|cad|pdf|dwg|最终版|送审版)"

# (all words, kind); first match wins
COMPONENT_KINDS = [
    (["甘特"], "gantt"),
    (["进度", "图"], "gantt"),
    (["组织", "图"], "organization_chart"),
    (["流程"], "flowchart"),
    (["图"], "flowchart"),
    (["表"], "table"),
    (["清单"], "table"),
    (["CAD"], "cad_reference"),
    (["总平"], "cad_reference"),
    (["附件"], "attachment"),
]
MISSING_ROLE_LABELS = [
    ("design_report", "初步设计或批复报告", "high"),
    ("budget", "预算或工程量清单", "high"),
    ("drawing", "设计图纸或CAD图纸包", "medium"),
]
INPUT_KEYWORDS = {
    "招标文件": ["招标", "技术标", "施工组织设计"],
    "引用规范": ["规范", "标准", "规程"],
    "总工期": ["工期"],
    "质量目标": ["质量"],
}
BLUEPRINT_GROUPS = [
    ("01", "编制说明及工程概况", ["01", "02"]),
    ("02", "施工总体部署及总平面布置", ["03", "04"]),
    ("03", "施工进度计划及保证措施", ["05"]),
    ("04", "主要施工方案与关键技术措施", ["06", "13", "14"]),
    ("05", "质量管理体系与材料试验管理", ["07", "12"]),
    ("06", "安全文明施工、环境保护与应急措施", ["08", "09"]),
    ("07", "项目人员、劳动力、机械设备与仪器配置", ["10", "11"]),
    ("08", "资料管理、验收配合及招标附件", ["15"]),
]
BLUEPRINT_MODULE_SECTION = "06"
GLOBAL_SECTION = "全局"
DIAGRAM_HEADING = wide(r"^(#{1,4})\s+.*(?:组织机构图|流程图)\s*$")
DIAGRAM_LINE = r"[|│─—┌┐└┘├┤┬┴┼↓↑→←]"
DIAGRAM_NOTE = "图示由系统以原生图形组件生成，见本节末。"
TRACE_HEADING = "本章依据追溯"
STANDARD_READY = ["available", "not_applicable"]
STANDARD_QUEUE = ["pending_download", "metadata_only", "blocked"]
REVIEW_STATES = ["open", "resolved", "dismissed"]
CASE_REVIEW_STATES = ["pending_review", "confirmed", "needs_correction"]
BLOCKING_CATEGORIES = ["资料冲突", "视觉资料冲突"]
CONTRACTS = {
    "standard": {
        "required": ["code", "title"],
        "enums": {
            "status": [
                "pending_download", "available", "metadata_only", "blocked", "not_applicable", "needs_confirmation",
            ]
        },
    },
    "clause": {
        "required": ["standard_code", "clause_id", "text", "source_path"],
        "enums": {
            "mandatory_level": ["mandatory", "recommended", "unknown"],
            "verification_status": ["verified_local_source", "needs_confirmation"],
        },
    },
    "asset": {
        "required": ["asset_id", "case_id", "case_title", "title", "content"],
        "enums": {
            "asset_type": ["outline", "wording", "table", "diagram", "layout", "style_note"],
            "reuse_rule": ["structure_only", "replace_parameters", "layout_only"],
        },
    },
    "fact": {
        "required": ["key", "value", "source_path"],
        "enums": {"status": ["extracted", "confirmed", "conflicted", "needs_confirmation"]},
    },
    "confirmation": {
        "required": ["category", "title", "detail"],
        "enums": {"severity": ["low", "medium", "high"], "status": ["open", "resolved", "dismissed"]},
    },
    "section": {"required": ["code", "title", "purpose"], "enums": {}},
}
