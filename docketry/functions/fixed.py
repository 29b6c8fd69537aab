"""Word lists, character tables, patterns and limits that fix the results."""

from __future__ import annotations

# Character tables of the text normalisation.
QUOTES_FROM, QUOTES_TO = "“”„‟«»‘’‚‛", "\"\"\"\"\"\"''''"
BRACKETS_FROM, BRACKETS_TO = "【】〔〕［］「」『』〈〉《》", "[][][][][]<><>"
MIDDOTS = "·ᆞ•∙⋅・·‧"
LEADER_CHARS = "·ᆞ•∙⋅・·‧․…‥"
FIELD_PUNCTUATION = r"""[()\[\]{}<>「」『』.,·:;/\\'"’”“‘\-–—]"""
TOKEN_PUNCTUATION = r"(?U)[\s()\[\]·.\-]"

# Page types.
TOC_LEADER_RATIO, TABLE_SHORT_RATIO, TABLE_MIN_LINES, SHORT_LINE_CHARS = 0.15, 0.60, 10, 20
GUTTER_MIN_WIDTH, GUTTER_CENTRE, GUTTER_BINS = 0.03, (0.30, 0.70), 100

# Retrieval.
MIN_CHUNK, MAX_CHUNK, RRF_K, BM25_K1, BM25_B, BM25_EPSILON = 40, 600, 60, 1.5, 0.75, 0.25

# Approval cells.
ROLES = ("기안", "검토", "결재", "협조")
NO_CELL, UNREADABLE = "-", "?"

# Document and work types, first match wins.
DOC_TYPES = (("지출", ("지출",)), ("계획", ("계획",)), ("결과보고", ("결과보고", "회의록")), ("알림", ("알림", "통보", "제출", "요청", "승인")))
DOC_TYPE_DEFAULT = "기타"
WORK_TYPES = (
    ("회계지출", ("지출", "수당", "보험료", "렌탈료", "임금", "구입")),
    ("계약·검사", ("기성검사", "준공", "계약", "검사")),
    ("회의·심의", ("위원회", "협의회", "회의록", "심의")),
    ("인사·복무", ("임용", "호봉", "승진", "복무", "겸직")),
    ("사업계획", ("계획",)),
    ("대외제출·통보", ("제출", "통보", "승인", "알림")),
    ("결과보고", ("결과", "복명", "출장")),
)
WORK_TYPE_DEFAULT = "결과보고"

# Levels by ending of a title, first match wins.
TITLE_LEVELS = ((("부군수",), 4), (("군수",), 5), (("국장",), 3), (("과장", "담당관", "사업소장"), 2), (("팀장", "소장"), 1))

# Title words.
RETRIEVAL_STOP = (
    "관한", "등의", "등에", "대한", "위한", "및", "일부개정", "일부개정령", "일부개정법률", "시행령", "시행규칙", "법률", "규정", "고시", "공고", "개정",
)
LAYER_STOP = (
    "관련", "계획", "결과", "보고", "운영", "추진", "알림", "요청", "실시", "대한", "위한", "개최", "제출", "검토", "사항", "관한", "따른", "안내", "협조", "시행", "방안", "현황",
)
HONORIFICS = "(?:국회의원|의원|위원장|위원|장관|교수|대표|님|씨)"

# Patterns of the extractors.
AMOUNT, AMOUNT_LOOSE = r"금\s*([\d,]+)\s*원", r"(\d{1,3}(?:,\d{3})+)\s*원"
AMOUNT_ALL = r"(?<![\d,])(\d{1,3}(?:,\d{3})+|\d{4,})\s*원"
DATE = r"(\d{4})\s*[.\-]\s*(\d{1,2})\s*[.\-]\s*(\d{1,2})"
DOC_NO_ALL = r"[가-힣]{2,12}-\d{2,7}"
#: Behind a document's number stands neither a further digit nor a unit, as behind an amount.
DOC_NO_END = r"(?![\d,.]*\d|[천만억]|원|%)"
#: Commas between groups of three digits.
GROUPING = r"(?<=\d),(?=\d{3}(?!\d))"
DOC_NO = r"([가-힣]{2,12})\s*-\s*(\d{1,7})"
SUBJECT = r"제\s*목\s*[:：]?\s*(.+)"
ISSUER = r"([가-힣]{2,12}?(?:부|청|처|위원회|도|시|군|구|원|공사|공단))(?:장관|장|지사|시장|군수|구청장|위원장)"
PARTICLE = r"(?:와의|과의|으로|에게|와|과|이|가|은|는|을|를|의|에|로)$"
VENDOR = r"(?:\(주\)|㈜|주식회사)\s*([가-힣A-Za-z0-9&]{2,20})|([가-힣A-Za-z0-9&]{2,20})\s*(?:\(주\)|㈜)|(?:업\s*체\s*명?|계약\s*상대자|상\s*호)\s*[:：]\s*([^\n,()]{2,30})"
RANGE = r"(\d+(?:\.\d+)?)\s*(억|천만|백만|만)\s*원\s*(초과|이상|이하|미만)?"
RANGE_UNITS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}
WON_UNITS = {"천원": 1_000, "백만원": 1_000_000, "원": 1}
NUMBER, NUMBER_WIDE = r"\d[\d,\-.]*", r"\d[\d,.]*\d"
TOC_KIND = r"(법률|대통령령|총리령|부령|고시|공고|훈령|예규|규칙)\s*제\s*([0-9][0-9\-]*)\s*호"
TOC_LEADER = r"[·․.．]{3,}\s*(\d+)\s*$"
TOC_BULLET = "○"
NAME_MASK = "○○○"

# Headings of drafts, table labels that are none, and words that are no key phrases.
SECTION = r"(?mdU)^[\s○·\-]*(\d{1,2})\s*[.)]\s*([^\n]{1,30})"
DATE_LIKE = r"(?U)^\s*\d{2,4}\s*[.\-/]"
TABLE_LABELS = ("등록번호", "등록일자", "결재일자", "공개구분", "접수", "시행")
DRAFT_STOP = (
    "합니다", "하고자", "다음과", "같이", "관련", "대하여", "따라", "위하여", "위한",
    "사항", "내용", "경우", "우리", "해당", "제출", "붙임", "기타", "아래", "통하여",
)
LAST_BODY_PAGES = 12
PROMPT_MARKS = ("## 참고문서", "# 작성할 문서", "본문:", "위 제목으로 문서 본문")

# Approval cells on a page. Windows: least and most dx, least and most dy.
TITLE_HINTS = (
    "기록연구사", "환경연구사", "환경연구관", "본부장", "센터장", "담당관", "주사보",
    "연구관", "연구사", "전문위원", "서기관", "사무관", "주무관", "지사장", "교도소장",
    "부소장", "장관", "차관", "실장", "국장", "과장", "팀장", "관장", "원장", "소장",
    "부장", "계장", "차장", "주사", "서기", "교위", "교감", "청장", "시장", "군수",
)
PAIR_WINDOWS = {"bottom": (0.0, 95.0, -8.0, 30.0), "top": (-45.0, 45.0, 8.0, 95.0), "override": (-45.0, 95.0, -8.0, 95.0)}
WRAP_LEFT, WRAP_CENTRE, WRAP_DOWN = 14.0, 22.0, 26.0
COOPERATION_MARK = "협조자"

# Where a page's approval cells stand, in shares of its height or width, or in points.
TOP_BAND, BOTTOM_BAND = 0.30, (0.70, 0.93)
BAR_MIN_WIDTH, BAR_MAX_HEIGHT, BAND_HEIGHT, ISSUE_MARK = 0.60, 12.0, 80.0, "시행"

# Delegation tables.
LEVEL_NAMES = {0: "주무관", 1: "팀장", 2: "과장", 3: "국장", 4: "부군수", 5: "군수"}
HEADER_LEVELS = (
    ("부군수", 4), ("부시장", 4), ("군수", 5), ("시장", 5), ("국장", 3), ("직속기관장", 3), ("담당관", 2),
    ("과장", 2), ("사업소장", 2), ("과소장", 2), ("팀장", 1), ("주무관", 0), ("담당자", 0),
)
MARKS = ("○", "◯", "O", "ㅇ", "●")
COMMON_SHEET = "(공통"

# How a predicted field differs from the true one.
REASONS = {"same": "일치", "missing": "미추출", "no_truth": "정답없음", "part": "부분일치(추출값이 정답의 일부)", "more": "부분일치(추출값이 정답보다 김)", "other": "불일치"}

# Labelled amounts, laws, and fields of an attachment.
LABEL_GAP = r"[^\d\n]{0,12}?([\d,]{3,})\s*(천원|백만원|원)"
NUMBER_LINE = r"^[\d,]{5,}원?$"
TABLE_UNIT = r"단위\s*[:：]?\s*(천원|백만원|원)"
LAW = r"[「『]([^」』]{2,40})[」』]"
UNFOUNDED_REF, UNFOUNDED_LAW = "[확인 필요]", "[근거 확인 필요]"
ATTACHMENT_FIELDS = {
    "amount": r"(?:지\s*급\s*액|금\s*액|합\s*계)\s*[:：]?\s*([^\n]*\d[\d,]*\s*원[^\n]*)",
    "breakdown": r"산\s*출\s*내\s*역\s*[:：]?\s*([^\n]+)",
    "period": r"(?:사\s*용|근\s*무|사\s*업)?\s*기\s*간\s*[:：]\s*([^\n]+)",
    "payee": r"지\s*급\s*대\s*상\s*[:：]?\s*([^\n]+)",
    "method": r"결\s*제\s*방\s*법\s*[:：]?\s*([^\n]+)",
    "budget": r"예\s*산\s*과\s*목\s*[:：]?\s*([^\n]+)",
}
ATTACHMENT_CHARS = 120
