"""driftmark.plans"""
