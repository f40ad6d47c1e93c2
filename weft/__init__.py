"""weft: enrich text tables with a language model (or any batch text function) on Spark."""

from .operators.backends import Backend, CallableBackend, CountingBackend, FingerprintBackend  # noqa: F401
from .operators.inference import RateLimited, RetryPolicy, call_model, land  # noqa: F401
from .plans.enrich import EnrichSpec, enrich, enrich_distinct, pack_requests, with_row_key  # noqa: F401
from .plans.job import EnrichJob, run  # noqa: F401
from .plans.retry import enrich_with_fallback, retry_failed  # noqa: F401
from .streaming.incremental import enrich_stream, load_state, resume, run_incremental, save_state  # noqa: F401
