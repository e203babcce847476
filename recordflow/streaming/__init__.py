"""The same operators on streams."""

from .lines import register as register_lines
from .state import keyed_head, keyed_numbers, keyed_profile, keyed_tail, use_state_store
from .streams import follow, join_streams, run_available, running_counts, session_counts, sliding_counts, tumbling_counts, with_table
from .watch import register as register_watch

__all__ = ["follow", "join_streams", "keyed_head", "keyed_numbers", "keyed_profile", "keyed_tail", "register_lines", "register_watch", "run_available", "running_counts", "session_counts", "sliding_counts", "tumbling_counts", "use_state_store", "with_table"]
