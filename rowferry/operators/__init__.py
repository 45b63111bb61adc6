"""Set-based operators: frames in, frames out, nothing passes through the driver."""
