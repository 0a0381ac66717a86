"""claimlake: checks what workflow logs claim against what tables hold, in bulk, on Spark."""
