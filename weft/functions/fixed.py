"""Fixed values.

Everything in this module must equal the text the original tool sends to,
or expects from, the model: prompt skeletons, sentinel results, task
templates, error markers and JSON field names.  They are stated here
plainly, in natural order, so that prompts rendered by Spark are byte-for-byte
the prompts the original tool would send (checked by md5 against DuckDB).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt skeleton fragments (Vietnamese, exact text)
# ---------------------------------------------------------------------------
CONTENT_HEADER = "Nội dung cần xử lý:"          # single-row prompt, before the text
RESULT_FOOTER = "Kết quả:"                      # single-row / item prompts, last line
RESULT_FOOTER_UPPER = "KẾT QUẢ:"                # indexed pack prompts, last line
COLUMNS_HEADER = "THÔNG TIN CÁC CỘT:"           # column definitions block
DATA_HEADER = "DỮ LIỆU CẦN XỬ LÝ:"              # data block
COLUMN_WORD = "Cột"                             # "- Cột {i} ({name}): {name}"
BATCH_GUIDE_HEADER = "HƯỚNG DẪN BATCH PROCESSING:"
BATCH_GUIDE_COUNT = "- Xử lý {n} mục dữ liệu dưới đây"
BATCH_GUIDE_COLUMNS = "- Mỗi mục có {c} cột thông tin"
BATCH_GUIDE_ORDER = "- Trả về kết quả theo thứ tự tương ứng"
BATCH_GUIDE_FORMAT = "- Format: [1] Kết quả 1\n[2] Kết quả 2\n[3] Kết quả 3..."
ITEMS_HEADER = "XỬ LÝ BATCH {n} ITEMS:"
ITEMS_TEXT_INSTRUCTION = (
    "Hãy trả về kết quả cho từng item theo format:\n"
    "Item 1: [kết quả item 1]\n"
    "Item 2: [kết quả item 2]\n"
    "...\n"
    "Item {n}: [kết quả item {n}]"
)
ITEMS_JSON_INSTRUCTION = (
    "QUAN TRỌNG: Hãy trả về kết quả cho từng item theo format JSON array:\n"
    "[\n"
    '  {{"item_id": 1, ...}},\n'
    '  {{"item_id": 2, ...}},\n'
    "  ...,\n"
    '  {{"item_id": {n}, ...}}\n'
    "]\n"
    "\n"
    'Mỗi JSON object phải có field "item_id" để xác định thứ tự.\n'
    "CHỈ trả về JSON array, KHÔNG có text khác."
)
MISSING_VALUE = "N/A"                           # rendered for a NULL column value

# ---------------------------------------------------------------------------
# FIXED VALUES: sentinel results written into the projected AI_RESULT column
# ---------------------------------------------------------------------------
NO_DATA = "Không có dữ liệu"
NO_RESPONSE = "Không có response"
PACK_PARSE_MISSING_SYNC = "Lỗi parse kết quả"
PACK_PARSE_MISSING_ASYNC = "Parse failed - missing result"
EMPTY_PACK_RESPONSE = "Empty response - Batch processing failed"
EMPTY_PACK_API = "Empty response - API error"
EMPTY_RESPONSE = "Empty response"
JSON_PARSE_FAILED_PREFIX = "JSON parse failed - Response: "
JSON_OBJECT_MISSING = '{"error": "JSON object missing from batch response"}'
RETRY_FAILED_PREFIX = "Retry failed: "
BATCH_ERROR_PREFIX = "Batch error: "
PROMPT_EMPTY = "Prompt không được để trống"
PROMPT_TOO_SHORT = "Prompt quá ngắn (tối thiểu 10 ký tự)"
PROMPT_OK = "Prompt hợp lệ"
PATH_EMPTY = "Đường dẫn file không được để trống"
PATH_MISSING = "File không tồn tại: {path}"
PATH_UNSUPPORTED = "Định dạng file không được hỗ trợ. Chỉ hỗ trợ: {formats}"
PATH_OK = "File hợp lệ"
ETA_PREFIX = "Dự kiến hoàn thành: "
ETA_UNKNOWN = "Không thể ước tính"
ERROR_AFTER_RETRIES = "Lỗi xử lý sau {n} lần thử"

# ---------------------------------------------------------------------------
# FIXED VALUES: provider response extraction messages
# ---------------------------------------------------------------------------
API_MISSING_CANDIDATES = "API Error: Missing candidates in response"
API_EMPTY_CANDIDATES = "API Error: Empty candidates array"
API_MISSING_CONTENT = "API Error: Missing content in candidate"
API_MISSING_PARTS = "API Error: Missing parts in content"
API_EMPTY_PARTS = "API Error: Empty parts array"

# ---------------------------------------------------------------------------
# FIXED VALUES: task prompt templates (name -> instruction), original order
# ---------------------------------------------------------------------------
TEMPLATES = {
    "summarize": "Hãy tóm tắt nội dung sau một cách ngắn gọn và rõ ràng bằng tiếng Việt:",
    "classify": "Hãy phân loại nội dung sau vào một trong các danh mục phù hợp:",
    "sentiment": "Hãy phân tích cảm xúc (tích cực/tiêu cực/trung tính) của nội dung sau:",
    "extract_keywords": "Hãy trích xuất các từ khóa quan trọng từ nội dung sau:",
    "translate": "Hãy dịch nội dung sau sang tiếng Việt:",
    "custom": "Hãy xử lý nội dung sau theo yêu cầu:",
    "json_classify": """Bạn là một hệ thống phân loại dữ liệu. Hãy phân tích nội dung và trả về kết quả theo định dạng JSON chính xác như sau:

{
    "category": "string hoặc null", 
    "product": "string hoặc null",
    "service": "string hoặc null", 
    "tag": "string hoặc null",
    "note_1": "string hoặc null"
}

QUY TẮC QUAN TRỌNG:
- Chỉ trả về JSON object duy nhất, không có text khác
- Sử dụng null cho các trường không tìm thấy thông tin
- Đảm bảo JSON syntax chính xác với double quotes
- Không sử dụng comments trong JSON""",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: error markers (case-insensitive substring match)
# ---------------------------------------------------------------------------
# used by the statistics report
STATS_ERROR_MARKERS = [
    "Lỗi",
    "Batch error",
    "failed after",
    "HTTP 429",
    "Timeout",
    "Connection error",
]
# used to pick rows for the retry pass (the six above plus six more)
RETRY_ERROR_MARKERS = STATS_ERROR_MARKERS + [
    "Rate limit",
    "Request failed",
    "API error",
    "Exception",
    "Error:",
    "❌",
]
# exception text that counts as a rate-limit signal (lower-case substring)
RATE_LIMIT_MARKERS = ["429", "quota", "rate_limit", "too_many_requests"]

# ---------------------------------------------------------------------------
# FIXED VALUES: JSON result schema
# ---------------------------------------------------------------------------
RESULT_FIELDS = ["category", "product", "service", "tag", "note_1"]
OTHER_SCHEMA_FIELDS = ["AI_SACTHAI", "AI_TOPICS", "AI_DOITUONG", "AI_THELOAINOIDUNG"]
RESULT_DELIMITER = "|"

# ---------------------------------------------------------------------------
# FIXED VALUES: fine-tuned prompt placeholders, replaced in this order
# ---------------------------------------------------------------------------
TEXT_PLACEHOLDERS = ["input_data", "input_text", "content", "message"]
PROMPT_PLACEHOLDERS = ["context_info", "context_data", "metadata", "additional_context"]

# ---------------------------------------------------------------------------
# FIXED VALUES: response-text prefixes stripped from numbered answers,
# header-like lines dropped by the delimiter fallback
# ---------------------------------------------------------------------------
ANSWER_PREFIXES = ["Kết quả", "Result"]
# capital letters after which a sentence boundary is accepted

# ---------------------------------------------------------------------------
# FIXED VALUES: shipped run settings
# ---------------------------------------------------------------------------
DEFAULT_TEXT_COLUMN = "MESSAGE"
RESULT_COLUMN = "AI_RESULT"
SYNC_PACK_SIZE = 10
ASYNC_PACK_SIZE = 5
CHUNK_SIZE = 100
RATE_LIMIT_RPM = 1000
MAX_RETRIES = 3
RETRY_DELAY_LINEAR_S = 60
RETRY_DELAY_SHORT_S = 5
RETRY_DELAY_EXP_BASE_S = 5
ROW_RETRY_ATTEMPTS = 2
ROW_RETRY_DELAY_S = 2
BREAKER_THRESHOLD = 3
MIN_PROMPT_CHARS = 10

# request bodies
GEMINI_GENERATION = {"temperature": 0.0, "topP": 0.8, "topK": 40, "maxOutputTokens": 30000, "candidateCount": 1}
GEMINI_SAFETY_CATEGORIES = [
    "HARM_CATEGORY_HARASSMENT",
    "HARM_CATEGORY_HATE_SPEECH",
    "HARM_CATEGORY_SEXUALLY_EXPLICIT",
    "HARM_CATEGORY_DANGEROUS_CONTENT",
]
GEMINI_SAFETY_THRESHOLD = "BLOCK_NONE"
OPENAI_TEMPERATURE = 0.3
OPENAI_MAX_TOKENS = 10000

# output naming
RESULT_FILE_PATTERN = "{stem}_ai_result_{stamp}.{ext}"
STATE_FILE_PATTERN = "{stem}_checkpoint.{ext}"
SUPPORTED_SUFFIXES = [".xlsx", ".csv", ".xls"]
# the original's decode order; utf-8-sig is UTF-8 with a byte order mark (stripped on read) and latin-1
# decodes every byte, so cp1252 is never reached: detection here is UTF-8 or ISO-8859-1 per file

# FIXED: the texts that pandas reads as missing by default
PANDAS_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
