"""Word lists and tables of the search language."""

# They decide which queries match what.
STOP_WORDS = frozenset(
    """
    은 는 이 가 을 를 의 에 에서 로 으로 와 과 도 만 부터 까지 에게 한테 께 하고 이고 라고 다고 고 면 니까 지만
    것 수 때 중 후 전 위 내
    the a an is are was were be been have has had do does did will would can could shall should may might must
    to of in for on with at by from as into through during before after and or but not no nor so yet
    how what when where which who why it its this that these those
    i me my we us our you your he him his she her they them their
    """.split()
)
KOREAN_PARTICLES = "에서 으로 부터 까지 에게 한테 하고 이고 라고 다고 지만 니까 은 는 이 가 을 를 의 에 로 와 과 도 만 께 고 면".split()
COMPOUND_PREFIXES = "re pre un non co de ex anti auto bi dis mis multi out over post semi sub super tri under inter intra macro micro".split()
ACRONYMS = frozenset(
    """
    API SQL CEO CTO CFO COO VP HR IT AI ML UI UX PR QA CI CD DB OS IP ID URL PDF CSV XML JSON HTML CSS JS TS
    AWS GCP SDK CLI GUI ORM MCP LLM ROI KPI OKR P&L PNL NDA SLA MOU IOT VPN DNS TCP UDP SSH FTP HTTP
    """.split()
)
EXPANSIONS = {
    "인증서": [".pfx", ".p12", ".cer", ".pem", "certificate"],
    "certificate": [".pfx", ".p12", ".cer", ".pem", "인증서"],
    "도면": [".dwg", ".dxf", ".dwf", "CAD", "drawing"],
    "cad": [".dwg", ".dxf", ".dwf", "도면"],
    "사진": [".jpg", ".jpeg", ".png", ".heic", ".raw", "photo"],
    "photo": [".jpg", ".jpeg", ".png", ".heic", "사진"],
    "동영상": [".mp4", ".avi", ".mov", ".mkv", "video"],
    "video": [".mp4", ".avi", ".mov", ".mkv", "동영상"],
    "음악": [".mp3", ".wav", ".flac", "music"],
    "music": [".mp3", ".wav", ".flac", "음악"],
    "한글": [".hwp", ".hwpx"],
    "워드": [".docx", ".doc", "word"],
    "word": [".docx", ".doc", "워드"],
    "엑셀": [".xlsx", ".xls", "excel"],
    "excel": [".xlsx", ".xls", "엑셀"],
    "파워포인트": [".pptx", ".ppt", "powerpoint", "PPT"],
    "powerpoint": [".pptx", ".ppt", "파워포인트"],
    "ppt": [".pptx", ".ppt", "파워포인트"],
    "pdf": [".pdf"],
    "압축": [".zip", ".rar", ".7z", ".tar", ".gz", "archive"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz", "압축"],
    "소스코드": [".cs", ".ts", ".tsx", ".js", ".py", ".java", ".cpp"],
    "스크립트": [".py", ".sh", ".bat", ".ps1"],
    "계약서": ["contract", "계약"],
    "contract": ["계약서", "계약"],
    "정관": ["AOI", "articles"],
    "이사회": ["board", "이사회의사록"],
    "주총": ["AGM", "주주총회"],
}
EXTENSION_BOOST = {
    ".docx": 1.5, ".doc": 1.5, ".xlsx": 1.5, ".xls": 1.5, ".pptx": 1.5, ".ppt": 1.5, ".pdf": 1.5, ".hwp": 1.5, ".hwpx": 1.5,
    ".txt": 1.2, ".rtf": 1.2, ".csv": 1.2, ".md": 1.2, ".msg": 1.2, ".eml": 1.2, ".html": 1.1, ".htm": 1.1,
    ".json": 0.5, ".xml": 0.5, ".yaml": 0.5, ".cfg": 0.5, ".log": 0.3, ".cs": 0.2, ".ts": 0.2, ".py": 0.2, ".js": 0.2, ".sh": 0.2,
}
CONTENT_EXTENSIONS = ".txt .md .csv .json .log .xml .pdf .docx .xlsx .pptx .rtf .odt .ods .odp .html .htm .eml .msg .hwp .hwpx".split()
TYPE_GROUPS = {
    "docx": [".docx", ".doc"],
    "xlsx": [".xlsx", ".xls", ".csv"],
    "pdf": [".pdf"],
    "pptx": [".pptx", ".ppt"],
    "hwp": [".hwp", ".hwpx"],
    "txt": [".txt", ".md", ".log"],
}
EXCLUDED_FOLDERS = [
    "Windows", "Program Files", "Program Files (x86)", "ProgramData", "$Recycle.Bin", "System Volume Information", "Recovery",
    "System", "Library", "Applications", ".Trash", ".Trashes", "Caches", "Containers", "Group Containers",
    ".Spotlight-V100", ".fseventsd", ".vol", "private", "cores", "Volumes",
    "AppData", "WindowsApps", "WpSystem", "MSOCache", "Searches", "Links", "3D Objects", "Contacts", "Saved Games", "MicrosoftEdgeBackups", "Favorites",
    "node_modules", ".git", ".vs", "obj", "bin", "__pycache__", ".cache", ".npm", ".nuget", "Intel", "AMD", "NVIDIA", "Temp", "tmp",
]
PACKAGE_SUFFIXES = ".app .framework .bundle .plugin .kext .xpc .appex".split()
# Steps of the document-family name: what is cut or replaced, in this order.
FAMILY_STEPS = [
    (r"\.[a-zA-Z0-9]{1,5}$", ""),
    (r"^[★※◆■●▶▷◇□△▲♦♠♣♥♡☆◎○◈►]+\s*", ""),
    (r"(?i)^\s*(복사본|사본|Copy\s+of|복사\s*[-–—])\s*", ""),
    (r"(?<!\d)20\d{2}[-./]?\d{2}[-./]?\d{2}(?!\d)", ""),
    (r"(?<!\d)[012]\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)", ""),
    (r"(?i)(?:^|(?<=[\s_\-]))(?:v\d+|vDraft|final|approved|signed|executed|rev\d+|ver\d+|최종|수정본|수정|완료|개정)(?=[\s_\-.]|$)", ""),
    (r"[\(\[\{]\s*\d+\s*[\)\]\}]|#\d+|_\d{1,2}(?=[_\s.]|$)|\d{1,2}차", ""),
    (r"[\[\]\(\)\{\}「」【】_\-–—.,;:~]+", " "),
    (r"\s{2,}", " "),
]
COPY_NAME = r"(?i)\(\d+\)$|복사본|[\s\-]copy$"
