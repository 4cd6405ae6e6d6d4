"""Default parameters. Every operator takes its lexicon as an argument; these are the defaults."""

# ---- Fixed values: they decide results, so they are stated as they are. ----

STOPWORDS = ("的", "了", "是", "在", "和", "与", "或", "什么", "如何", "怎么", "哪个")

# (category, keywords), in priority order.
ROUTES = (
    ("craft_expert", ("制作", "流程", "工艺", "材料", "工具", "步骤", "技术", "做法", "工序", "配方")),
    ("history_expert", ("历史", "起源", "演变", "朝代", "文化", "意义", "传说", "来历", "发展")),
    ("heritage_expert", ("传承", "传承人", "学习", "保护", "现状", "濒危", "非遗", "政策", "如何学", "哪里学")),
)

AGENT_NAMES = {
    "craft_expert": "技艺知识Agent",
    "history_expert": "历史文化Agent",
    "heritage_expert": "传承现状Agent",
}

AGENT_TYPES = {
    "craft_expert": "技艺知识专家",
    "history_expert": "历史文化专家",
    "heritage_expert": "传承现状专家",
}
UNKNOWN_AGENT_TYPE = "未知专家"

NARRATIVE_WORDS = ("讲讲", "说说", "听听", "师傅", "传承人", "口述", "故事")

ENTITIES = ("景泰蓝", "苏绣", "龙泉青瓷", "宜兴紫砂", "芜湖铁画", "蜀锦")

DEBATE_WORDS = {
    "how": ("为什么", "如何", "怎么", "怎么样", "原因", "分析", "比较"),
    "why": ("为什么", "原因", "为何", "分析", "道理"),
    "future": ("传承", "困境", "挑战", "危机", "濒危", "保护", "发展"),
}

# mode -> (round, agent, role) in turn order.
DEBATE_PLANS = {
    "progressive": (
        (1, "craft_expert", "主答"),
        (2, "heritage_expert", "补充"),
        (3, "history_expert", "深化"),
        (4, "craft_expert", "回应"),
    ),
    "parallel": (
        (1, "craft_expert", "并列发言"),
        (1, "history_expert", "并列发言"),
        (1, "heritage_expert", "并列发言"),
        (2, "craft_expert", "质疑"),
        (2, "heritage_expert", "回应"),
    ),
    "multi_perspective": (
        (1, "craft_expert", "技艺视角"),
        (2, "history_expert", "历史视角"),
        (3, "heritage_expert", "传承视角"),
        (4, "craft_expert", "质疑与反思"),
        (5, "heritage_expert", "综合回应"),
    ),
    "simple": ((1, "craft_expert", "主答"),),
}

REFERENCE_PATTERNS = (
    r"来源[:：]\s*(.+?)(?:\n|$)",
    r"出自[:：]\s*(.+?)(?:\n|$)",
    r"参考[:：]\s*(.+?)(?:\n|$)",
)

SYNONYMS = (
    ("制作", ("制作", "制作技艺", "工序", "工艺流程", "制作方法")),
    ("历史", ("历史", "起源", "发展历程", "演变", "传承")),
    ("材料", ("材料", "原料", "用料", "成分")),
    ("传承", ("传承", "传承人", "传承技艺", "代代相传")),
    ("特色", ("特色", "特点", "特征", "独特之处")),
    ("价值", ("价值", "意义", "重要性", "作用")),
    ("技艺", ("技艺", "技术", "工艺", "技法")),
    ("文化", ("文化", "文化内涵", "文化价值")),
)

CLASS_NAMES = {
    "jingtailan": "景泰蓝",
    "suxiu": "苏绣",
    "longquan_ci": "龙泉青瓷",
    "yixing_zisha": "宜兴紫砂",
    "wuhu_tiehua": "芜湖铁画",
    "shujin": "蜀锦",
}

# (id, name, description, depth, min length, max length, focus)
PROFILES = (
    ("curious", "好奇者", "对非遗技艺有初步兴趣，想要了解基本情况", "shallow", 300, 500,
     ("基本概念", "趣味点", "简单历史")),
    ("learner", "学习者", "想要深入学习非遗技艺，具备一定基础", "medium", 800, 1500,
     ("完整知识体系", "操作要点", "练习建议")),
    ("researcher", "研究者", "需要深度资料用于学术研究或专业创作", "deep", 2000, 5000,
     ("完整技术细节", "历史文献", "统计数据")),
)
DEFAULT_PROFILE = "curious"

COVERAGE_LABELS = {"sufficient": "✅ 充足", "partial": "⚠️ 部分覆盖", "missing": "❌ 缺失"}

NODE_COLORS = {
    "craft": "#8B4513",
    "material": "#2E7D32",
    "tool": "#1565C0",
    "inheritor": "#EF6C00",
    "region": "#7B1FA2",
    "dynasty": "#C62828",
    "unknown": "#757575",
}

NODE_TYPE_NAMES = {
    "craft": "技艺",
    "material": "材料",
    "tool": "工具",
    "inheritor": "传承人",
    "region": "地域",
    "dynasty": "朝代",
    "unknown": "其他",
}

RELATION_NAMES = {
    "uses_material": "使用材料",
    "uses_tool": "使用工具",
    "mastered_by": "传承人掌握",
    "originates_from": "发源于",
    "originated_in": "起源于",
    "related_to": "与...相关",
    "influenced_by": "受...影响",
}

# A relation whose name contains the word gets the colour.
RELATION_COLORS = (("material", "#2E7D32"), ("tool", "#1565C0"), ("mastered", "#EF6C00"))
OTHER_RELATION_COLOR = "#9E9E9E"

UPLOAD_TYPES = ("text/plain", "text/markdown", "application/json")
