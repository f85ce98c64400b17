"""Default lexicons and labels; all are parameters of the operators that use them."""

# They must equal the reference's for right results.
FOREIGN_PHRASES = ["한글자막 제공", "자막 제공 및 협조", "다음 영상에서 만나요", "구독과 좋아요", "진심으로 감사드립니다", "좋아요와 구독", "채널을 구독", "영상이 도움이 되셨다면"]
MANAGER_KEYWORDS = ["어르신", "혈압", "재볼까", "드셨어요", "하셨어요", "다음에", "가져올게", "제가", "드릴게", "확인", "운동", "약", "식사", "가르쳐", "알려드릴게"]
DANGER_KEYWORDS = {"폭언": ["씨발", "개새끼", "죽여", "꺼져"], "낙상": ["넘어졌", "떨어졌", "미끄러", "넘어질"], "사망": ["돌아가", "죽었", "사망"], "통증": ["아파", "아프", "쑤시", "찌릿"]}
POLITE_SUFFIXES = ["요?", "죠?"]
EMOTIONS = ["기쁨", "당황", "분노", "불안", "슬픔", "중립"]
TONES = {"기쁨": "밝음, 긍정적", "당황": "당혹감, 혼란", "분노": "격앙됨, 불만", "불안": "불안, 두려움", "슬픔": "우울함, 침울함", "중립": "차분함, 담담함"}


# Words for levels, as results show them.
RELATIVE_PITCH = {"much_lower": "훨씬낮음", "lower": "낮음", "normal": "평소", "higher": "높음", "much_higher": "훨씬높음"}
VARIABILITY = {"low": "안정", "normal": "보통", "high": "큼"}
ENERGY_TONES = {"low": "기력 없는 톤", "normal": "안정적인 톤", "high": "활기찬 톤"}
RATES = {"slow": "느린 말속도", "normal": "보통 속도", "fast": "빠른 말속도"}
