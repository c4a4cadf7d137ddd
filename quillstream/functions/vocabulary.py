"""Fixed values of the document model: tags, keywords, connectives, limits, formats."""

# The thirteen tags in order; the last is the fallback.
TAGS = [
    "标题", "摘要", "项目研究意义", "国内外研究现状及发展动态分析", "科学意义与应用前景", "项目的研究内容", "研究目标",
    "拟解决的关键科学问题", "研究方法", "技术路线", "关键技术", "本项目的特色与创新之处", "其他",
]
TITLE, ABSTRACT, OTHER = TAGS[0], TAGS[1], TAGS[-1]

# Keywords that stand for a tag, in the order they are tried.
TAG_KEYWORDS = [
    ("标题", ["标题", "题目", "title"]),
    ("摘要", ["摘要", "abstract", "概述", "简介"]),
    ("项目研究意义", ["意义", "重要性", "价值"]),
    ("国内外研究现状及发展动态分析", ["现状", "动态", "综述", "进展", "发展"]),
    ("科学意义与应用前景", ["前景", "应用", "科学意义"]),
    ("项目的研究内容", ["研究内容", "内容"]),
    ("研究目标", ["目标", "目的"]),
    ("拟解决的关键科学问题", ["科学问题", "问题", "关键问题"]),
    ("研究方法", ["方法", "手段"]),
    ("技术路线", ["路线", "步骤", "流程"]),
    ("关键技术", ["关键技术", "技术难点"]),
    ("本项目的特色与创新之处", ["特色", "创新", "独特"]),
]
#: The unified variant knows one more keyword of the third tag.
UNIFIED_EXTRA = ("项目研究意义", "必要性")

# Words that continue the sentence before.
CONNECTIVES = ["而且", "并且", "因此", "所以", "但是", "然而", "此外", "另外", "同时"]

# Layout types that are no text of the document.
SKIPPED_LAYOUTS = ["head", "head_image", "foot", "foot_image", "head_pagenum", "foot_pagenum", "page"]

FORMATS = [".txt", ".pdf", ".doc", ".docx"]
MAX_UPLOAD_MB = 50
VERSION = "v1"
SERVICE_VERSION = "1.0.0"
LONG_PARAGRAPH, SHORT_SEGMENT, PRESEGMENT, SHORT_FALLBACK, UNIFIED_BLOCK = 3000, 50, 150, 200, 8000
LABEL_BATCH, SENTENCE_BATCH, SMOOTH_BELOW = 15, 30, 0.7
