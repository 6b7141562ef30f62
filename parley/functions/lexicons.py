"""Default lexicons of the conversation analytics. Operators take lexicons as arguments; these are their defaults."""

# Word lists that decide results.
NEGATIVE = ["生气", "烦", "累", "难过", "伤心", "失望", "无语", "算了", "不想", "讨厌", "为什么", "怎么", "总是", "从不", "不理", "冷", "忙", "没空", "不回", "吵", "闹", "分手", "离开", "不爱", "不喜欢", "受不了", "够了"]
POSITIVE = ["爱你", "想你", "喜欢", "开心", "幸福", "甜", "亲爱", "宝贝", "老公", "老婆", "谢谢", "感谢", "抱抱", "亲亲", "么么", "❤", "😘", "🥰", "💕", "好棒", "厉害", "支持", "加油", "相信"]
NEGATIVE_TAGS = ["ANGRY", "SAD", "FEARFUL", "DISGUSTED"]
TAG_CONFLICTS = [(["HAPPY", "EXCITED"], ["ANGRY", "SAD", "FEARFUL"]), (["ANGRY"], ["HAPPY", "NEUTRAL"]), (["SAD"], ["HAPPY", "EXCITED"])]
TOPICS = {
    "工作": ["工作", "上班", "加班", "公司", "老板", "同事", "项目", "面试", "录取"],
    "家庭": ["家", "父母", "妈", "爸", "孩子", "婆婆", "公公", "家里"],
    "金钱": ["钱", "买", "花", "存", "贵", "借", "还"],
    "感情": ["爱", "喜欢", "想", "在乎", "心疼", "舍不得"],
    "生活": ["吃", "睡", "玩", "出去", "旅游", "做饭"],
    "未来": ["以后", "将来", "计划", "打算", "结婚", "房子"],
    "社交": ["朋友", "聚会", "饭局", "同学", "闺蜜", "兄弟"],
    "健康": ["身体", "累", "病", "头疼", "失眠", "压力"],
}
EMOTIONS = {
    "开心": ["开心", "高兴", "快乐", "幸福", "哈哈", "嘻嘻", "情绪:HAPPY"],
    "生气": ["生气", "愤怒", "烦", "气死", "火大", "情绪:ANGRY"],
    "伤心": ["伤心", "难过", "哭", "心痛", "委屈", "情绪:SAD"],
    "焦虑": ["担心", "焦虑", "紧张", "害怕", "不安", "情绪:FEARFUL"],
    "甜蜜": ["爱你", "想你", "宝贝", "亲爱的", "抱抱", "氛围:温馨", "氛围:浪漫"],
    "冷淡": ["随便", "无所谓", "都行", "不想说", "算了", "cold_period"],
}
CONFLICT = ["生气", "烦", "吵", "闹", "不理", "分手", "你怎么", "你为什么", "凭什么", "受不了", "够了", "情绪:ANGRY", "氛围:紧张", "氛围:压抑", "argument_gap", "伤人"]
TREND_POSITIVE = ["爱", "喜欢", "开心", "幸福", "甜", "想你", "宝贝"]
TREND_NEGATIVE = ["烦", "累", "生气", "讨厌", "分手", "不想", "算了"]
INTENTS = {
    "emotional_venting": ["累", "烦", "烦死了", "好累", "疲惫", "压力大", "崩溃", "生气", "愤怒", "委屈", "难过", "伤心", "痛苦", "焦虑", "不想", "受不了", "撑不住", "要疯了", "无语", "绝望"],
    "information_query": ["什么时候", "在哪", "哪里", "几点", "什么时间", "如何", "怎么", "怎样", "为什么", "是什么", "谁", "哪个", "多少", "几个", "多久", "多长时间", "还有吗"],
    "casual_chat": ["在干嘛", "干嘛呢", "吃饭了吗", "睡了没", "忙吗", "你好", "哈喽", "嗨", "早上好", "晚上好", "晚安", "今天", "明天", "昨天", "周末", "天气", "最近"],
    "conflict_discussion": ["吵架", "争执", "冲突", "矛盾", "分歧", "不和", "又这样", "总是", "每次都", "又不理", "冷战", "生气了", "不开心", "闹脾气", "发脾气", "情绪化"],
    "relationship_advice": ["怎么办", "怎么处理", "如何解决", "建议", "意见", "应该", "不该", "对吗", "好吗", "可以吗", "帮我", "救救我", "求助", "指导", "分析"],
}
STRATEGIES = {
    "emotional_venting": ("emotional_support", 5, True, 0.3, 0.7),
    "information_query": ("factual_search", 3, True, 0.1, 0.9),
    "casual_chat": ("general_chat", 2, False, 0.2, 0.8),
    "conflict_discussion": ("conflict_analysis", 8, True, 0.4, 0.6),
    "relationship_advice": ("relationship_guidance", 6, True, 0.3, 0.7),
}
