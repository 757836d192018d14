"""Reading, writing and adapting event logs."""
