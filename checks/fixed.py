"""Values of the expected results, spelled out here so that a wrong value in the library shows as a difference."""
from types import SimpleNamespace

# labels
L = SimpleNamespace(
    CASE_HEADER={'success': '【已验证案例 · 成功】', 'partial': '【已验证案例 · 部分成功】', 'fail': '【已验证案例 · 失败 · 此路不通，不要照做】'},
    CASE_HEADER_UNKNOWN='【已验证案例】',
    CASE_NAME_PREFIX='案例 · ',
    CASE_SOURCE={'success': '你已验证的经验案例', 'partial': '你已验证的经验案例（部分成功）', 'fail': '你的失败记录（试过，没成）'},
    DELETED_NAME='(已删除)',
    FIX_LABEL='最终解决',
    FIX_LABEL_FAILED='试过的做法（未成功）',
    KIND_LABEL={'tds': 'TDS', 'spec': '规格书', 'report': '检验报告', 'sds': '安全表', 'other': '未分类'},
    OUTCOME_LABEL={'success': '成功', 'partial': '部分成功', 'fail': '失败'},
    OUTCOME_VERDICT={'success': 'ok', 'partial': 'warn', 'fail': 'no'},
    UNGROUPED='未分组',
    UNKNOWN_NAME='?',
    VERDICT_LABEL={'ok': '满足', 'no': '不满足', 'warn': '差一点'},
)

# notes of extraction quality
Q = SimpleNamespace(
    NOTE_EMPTY_BODY='文档正文为空',
    NOTE_LOW_QUALITY='文本提取质量较低，可能存在乱码',
    NOTE_NO_TEXT_LAYER='未检测到文本层，可能是扫描件（需要 OCR）',
)

# fields and errors of cases
C = SimpleNamespace(
    ERROR_FIX='请填写「最终怎么解决的」—— 这是案例最重要的字段',
    ERROR_FIX_FAILED='请填写「试过什么、后来怎样」—— 失败记录也有用，它拦住的是一次重复的失败',
    FIELD_CAUSE='根因：',
    FIELD_DATE='记录时间：',
    FIELD_ENVIRONMENT='环境：',
    FIELD_GAP='｜',
    FIELD_NOTES='注意：',
    FIELD_OUTCOME='结果：',
    FIELD_PROBLEM='现象：',
    FIELD_PRODUCT='产品/型号：',
    FIELD_TAGS='标签：',
)

# compliance prompt and reports
P = SimpleNamespace(
    CSV_HEAD='项目,要求,实际,判定,来源',
    MARKDOWN_HEAD='| 项目 | 要求 | 实际 | 判定 | 来源 |\n| --- | --- | --- | --- | --- |',
    PROMPT_CLOSE=('\n'
 '\n'
 '请严格只输出 JSON（不要 markdown 代码块、不要多余文字）：\n'
 '{"model":"匹配到的树脂体系名","items":[{"item":"指标名","required":"要求","actual":"实际","verdict":"ok|no|warn","source":"来源"}],"conclusion":"综合结论与建议"}'),
    PROMPT_CONTEXT='\n\n可选资料：\n',
    PROMPT_OPEN=('你是一名严谨的树脂材料选型工程师。\n'
 '下面是用户给出的「技术要求 / 工况要求」，以及资料库中可能相关的树脂 TDS 片段。\n'
 '请从中找出最匹配的一款树脂体系，并逐项核对要求，给出三态判定。\n'
 '\n'
 '判定规则：\n'
 '- verdict 只能是 "ok"（满足）/ "no"（不满足或超标）/ "warn"（差一点 / 临界 / 资料不足）\n'
 '- 每项给出 required（要求值）、actual（资料中实际值）、source（来源文档名 + 页码；若来自用户附件写「附件：文件名」）\n'
 '- 实际值找不到时，actual 写「资料未提供」，verdict 写 "warn"\n'
 '- 最后用 conclusion 给出综合结论与选型建议（哪款合适 / 差在哪里）\n'
 '\n'
 '技术要求：\n'),
    UNKNOWN_MODEL='未知',
)

# context, badges
X = SimpleNamespace(
    ATTACHMENTS_HEAD='【本次附件文本】\n',
    BADGE_BOTH='KW+SEM',
    BADGE_CASE='案例',
    BADGE_FAILED='失败案例',
    BADGE_KEYWORD='KW',
    BADGE_PINNED='钉住',
    BADGE_SEMANTIC='语义',
    CUT_BLOCK='…（本段已截断）',
    CUT_HEAD='（上下文已达长度上限，后面 ',
    CUT_TAIL=' 段未纳入本次回答）\n\n',
    EMPTY_CONTEXT='（资料库暂无相关内容）',
    PINNED_MARK='（钉住资料）',
)

# conversations
V = SimpleNamespace(
    ERROR_MARK='⚠️',
    HEAD_AI='## 助手',
    HEAD_USER='## 我',
    NEW_TITLE='新会话',
    NO_QUESTION='（未填写问题）',
    NO_TEXT='（无文字）',
    SEE_ATTACHMENT='（见本条附件）',
)

# library lines
B = SimpleNamespace(
    SOURCE_LABEL={'nas': 'NAS解析', 'local': '本地解析'},
    SOURCE_NONE='未能提取文本',
)

MODEL_BLOCK = ('ISO', 'GB', 'GBU', 'ASTM', 'DIN', 'JIS', 'EN', 'IEC', 'HTTP', 'WWW', 'PDF')

# by priority, as patterns of the other engine
KIND_RULES = (
    ('tds', r'T\.?D\.?S\.?|Technical\s*Data\s*Sheet|Product\s*Data|技术数据表|产品数据表|技术数据单'),
    ('spec', r'Spec(?:ification)?\b|采购规范|采购规格|技术规格|规格书|技术要求|技术条件'),
    ('report', r'C\.?O\.?A\.?|Certificate\s*of\s*Analysis|检验报告|检测报告|质检报告|分析报告|试验报告'),
    ('sds', r'M?S\.?D\.?S\.?|Safety\s*Data\s*Sheet|安全数据表|安全技术说明书'),
)
