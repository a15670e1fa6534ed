"""Fixed values that define results: limits, weights, patterns, word lists."""

# --- chunking
MAX_CHARS = 900
PREAMBLE_OVER = 30
PIECE_LEAST = 15
CLAUSE_MARKS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
BODY_RULE = "=" * 40

# --- keyword scoring
K1, B = 1.5, 0.75
TOKEN_LEAST = 2
SYNONYMS = {
    "자퇴": ["퇴학", "자퇴원"],
    "학고": ["학사경고"],
    "학사경고": ["학사징계"],
    "수강 변경": ["수강신청 정정", "수강정정"],
    "수강신청 변경": ["수강신청 정정", "수강정정"],
    "성적 이의": ["성적 이의신청", "성적열람"],
    "졸업유예": ["학사학위취득 유예", "수료유예"],
    "졸업 유예": ["학사학위취득 유예", "수료유예"],
    "복전": ["복수전공"],
    "부전": ["부전공"],
    "재입학": ["재입학 허가"],
    "출석": ["출석일수", "결석"],
    "등록금 환불": ["등록금 반환", "등록금의 반환"],
    "장학금 환불": ["장학금 환수", "장학금의 환수"],
}

# --- hybrid ranking
VECTOR_POOL = 200
VECTOR_FLOOR, KEYWORD_FLOOR = 0.44, 0.0
WEIGHTS, QUESTION_WEIGHTS = (0.6, 0.4), (0.75, 0.25)
QUESTION_WORDS = 3
QUESTION_PATTERN = (
    r"(\?|어떻게|어떡|언제|얼마|어디|누가|누구|무엇|뭐야|뭔가요|뭐예요|되나요|되요|"
    r"할\s*수|있나요|있어요|있을까|가능|하려면|해야|해요|인가요|일까|알려|궁금|"
    r"하나요|합니까|입니까|받으려면|신청하|가요$|나요$|까요$|죠$|지$)"
)
ATTACHED_SCHOOL = (r"부설\s*(고등|중)학교", r"부설|고등학교|중학교|고교|중등|학생부|내신", 0.85)
NON_ARTICLE = (r"^(부칙|별표|별지|서식|머리말|전문)", r"부칙|별표|별지|서식|양식|시행일|경과\s*조치|개정\s*이력|연혁|언제부터\s*시행", 0.8)
GRADUATE = (r"대학원", r"대학원|석사|박사|학위\s*논문|논문\s*제출|연구생|수료|대학원생|원생", 0.85)
REPEALED, IN_FORCE = "폐지", "현행"
MINMAX_EPSILON = 1e-9
RERANK_POOL, RERANK_GATE = 10, 0.05
MOST_RESULTS = 50
SOURCE_LEAST, SOURCE_FROM_K = 3, 8
SNIPPET_WIDTH = 90
CACHE_SIZE = 300

# --- answers
CONTEXT_SIZE, ANSWER_GATE = 5, 0.5
HISTORY_CHARS = 300
SHORT_FOLLOW_UP, REWRITE_LONGEST = 16, 80
NOT_FOUND = "해당 내용은 규정에서 찾을 수 없습니다."
SOURCES_MARK, WARNING_MARK = "[근거 조항]", "⚠️"
CITATION_WARNING = "\n\n⚠️ [자동 검증 경고] 이 답변에는 근거 조항 목록에 없는 규정명({names})이 포함되어 있습니다. 실제 근거 조항을 기준으로 다시 확인해주세요."
NUMBER_WARNING = "\n\n⚠️ [자동 검증 경고] 이 답변에 참고자료 원문에는 없는 숫자({numbers})가 포함되어 있습니다. AI가 스스로 계산했거나 지어냈을 수 있으니, 위 근거 조항의 원문을 직접 확인해주세요."
REFERENCE_WORDS = {"그럼", "그러면", "그건", "그거", "그것", "거기서", "그리고", "근데", "그래서", "또", "그리고요"}
QUESTION_TOKENS = {
    "언제", "언제까지", "어떻게", "얼마", "얼마나", "뭐야", "뭐예요", "왜", "무엇", "어디", "누가",
    "해", "해요", "하나요", "되나요", "인가요", "해야", "하지", "되지", "까지", "부터", "가능", "가능해",
    "돼", "돼요", "되", "됩니까", "되요", "될까", "있어", "있나요", "있을까",
}
GENERIC_NOUNS = {"기간", "절차", "방법", "조건", "요건", "서류", "기준", "시기", "한도", "비용", "금액", "횟수", "대상", "자격"}
PARTICLES = r"(은요|는요|은|는|이|가|도|요|을|를|에|에서|로|으로)$"
FOLLOW_UP_SKIP = {"목적", "정의", "적용범위", "적용 범위", "다른 규정과의 관계", "시행일", "위임"}
FOLLOW_UP_RESULTS, FOLLOW_UP_LIMIT = 2, 3
FOLLOW_UP_FORM = "{title}{particle} 어떻게 되나요?"

# --- logs
POPULAR_DEFAULTS = ["휴학", "복학", "장학금", "등록금", "수강신청", "졸업 요건", "연구비", "전과", "성적 이의신청", "마이크로디그리"]
POPULAR_STOP = ("테스트", "test", "asdf", "ㅁㄴㅇ")
POPULAR_LENGTH, POPULAR_LEAST = (2, 40), 2
COST_PER_CALL = 0.001
CATEGORY_ORDER = {"학칙": 0, "규정": 1, "지침": 2}
FEEDBACK_LIMITS = {"question": 500, "answer_preview": 300, "chunk_ids": 10, "comment": 500}
MORE_NAMES = " 외"
UNKNOWN_DEPARTMENT = "담당부서 미확인"
ATTACHED_FIRST = r"부설(고등|중)학교"
CONTACT_HEAD = ["출처", "담당부서", "현재 연락처", "해당 규정 수", "규정명(예시)", "검수결과(O/X)", "수정할 연락처"]

# --- ingestion
RULE_NOUNS = "정관|규정|지침|예규|세칙|요령|규칙|법|시행령"
TOC_PARAGRAPHS = 800
TITLE_RATIO = 0.9
HISTORY_KINDS = "제정|개정|전부개정|일부개정|폐지"
JUNK_PATTERNS = [
    r'조문목록( 없음)?"\s*src="[^"]*"\s*/>',
    r'체크박스"\s*value="[^"]*"\s*/>',
    r"'\);return false;\"\s*href=\"#AJAX\">",
    r'\w*+"\s*src="[^"]*"\s*/>',
    r'\w*+"\s*value="[^"]*"\s*/>',
]
BLOCK_TAGS = r"<(br|/p|/div|/li|/tr|/h\d)[^>]*>"
TAG = r"""<[!/]?[a-zA-Z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*/?>"""
CLICK_RESIDUE = r"'\);return false;\"[^>\n]*>"
ATTRIBUTE_RESIDUE = r'[\w가-힣 ]*+"\s+(?:src|value|alt|title)="[^"]*"\s*/?>?'
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f﻿]"
