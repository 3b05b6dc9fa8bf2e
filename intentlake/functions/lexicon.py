"""Word lists of the tokenizer and of query decomposition."""

from __future__ import annotations

# They must equal the published lists, or tokens and scores differ.
STOPWORDS = (
    "a", "an", "and", "api", "by", "for", "from", "get", "i", "in", "is", "me", "need", "of", "on", "or", "please", "the", "to", "tool",
    "use", "with",
)

# Synonyms of a word, in their order.
SYNONYMS = {
    "umbrella": ["rain", "weather", "forecast"],
    "rain": ["weather", "forecast"],
    "forecast": ["weather"],
    "hotel": ["stay", "lodging"],
    "hotels": ["stay", "lodging"],
    "stay": ["hotel", "lodging"],
    "flight": ["travel", "origin", "destination"],
    "fly": ["flight", "travel"],
    "meeting": ["calendar", "event", "attendees"],
    "meet": ["calendar", "event"],
    "calendar": ["meeting", "event"],
    "email": ["message", "recipient"],
    "note": ["email", "message"],
    "send": ["email", "message"],
    "usd": ["currency", "money", "amount"],
    "cny": ["currency", "money", "amount"],
    "eur": ["currency", "money", "amount"],
    "currency": ["money", "convert", "amount"],
    "change": ["convert", "currency"],
}

# Phrases, in the order in which they are looked for.
CJK_PHRASES = (
    "光场屏", "投影幕布", "投影光机", "后视镜", "中控屏", "仪表盘", "娱乐屏", "隐私玻璃", "侧方行驶", "蟹行", "驾驶模式", "运动模式",
    "舒适模式", "节能模式", "单踏板", "自动驻车", "自适应巡航", "车道辅助", "盲区监测", "碰撞预警", "画面", "画幅", "屏幕", "放大", "调大",
    "缩小", "调小", "取消", "关闭", "关掉", "禁用", "退出", "打开", "开启",
)

# Synonyms of a phrase, in their order.
CJK_SYNONYMS = {
    "取消": ["关闭", "关掉", "禁用", "退出", "off", "disable"],
    "关闭": ["取消", "关掉", "禁用", "off", "disable"],
    "关掉": ["关闭", "取消", "禁用", "off", "disable"],
    "禁用": ["关闭", "取消", "off", "disable"],
    "退出": ["取消", "关闭", "off", "disable"],
    "放大": ["调大", "变大", "增大", "increase", "enlarge"],
    "调大": ["放大", "变大", "增大", "increase", "enlarge"],
    "缩小": ["调小", "变小", "减小", "decrease"],
    "调小": ["缩小", "变小", "减小", "decrease"],
    "画面": ["画幅", "屏幕", "screen", "size"],
    "画幅": ["画面", "屏幕", "screen", "size"],
    "屏幕": ["画面", "画幅", "screen", "size"],
}

# Where a request is cut.
CONJUNCTIONS = ("并且", "同时", "以及", "然后", "还有", "另外", "再", "和", "与", "及", "，", ",", "、", "；", ";")

# Actions, in the order in which they are looked for.
ACTIONS = (
    "取消", "关闭", "关掉", "禁用", "退出", "打开", "开启", "启动", "上锁", "锁上", "解锁", "开锁", "切换", "设置", "设为", "调到", "调高",
    "调低", "调大", "调小", "放大", "缩小", "增加", "减少", "升高", "降低",
)
