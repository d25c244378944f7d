"""Preparation plans: a declared chain of steps run as one."""
